"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pepspark.llm.decontaminate import OP1_SQL, op1_decontamination
from pepspark.llm.html_text import op10_html_text
from pepspark.llm.jaccard_join import op4_ngram_jaccard
from pepspark.llm.language_model import op7_language_model
from pepspark.llm.media import op5_media_columns
from pepspark.llm.pieces import op2_sentencepiece
from pepspark.llm.secrets import op6_secret_scan
from pepspark.llm.substring_dedup import OP3_SQL, op3_substring_dedup
from pepspark.llm.toxicity import op8_toxicity
from pepspark.llm.warc import op9_warc

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_media_columns": op5_media_columns,
    "op6_secret_scan": op6_secret_scan,
    "op7_language_model": op7_language_model,
    "op8_toxicity": op8_toxicity,
    "op9_warc": op9_warc,
    "op10_html_text": op10_html_text,
}

ORACLE_SQL: dict[str, str] = {"op1_decontamination": OP1_SQL, "op3_substring_dedup": OP3_SQL}
