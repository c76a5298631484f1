"""Archives, page text, toxicity and the pipeline."""

import base64
import hashlib
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from pepspark.llm import html_text, media, toxicity, warc
from pepspark.llm.registry import QUERIES

TEST_DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("pages")
    rng = random.Random(5)
    menu = "home products about contact imprint privacy terms login"
    rows = [(1, "http://a.example/1", "same"), (2, "http://a.example/2", "same"), (7, "http://b.example/", "same"), (3, None, None), (4, "u", ""), (5, "x\r\ny", "<p>é" * 3000)]
    rows += [(10 + i, f"http://h.example/{i}", f"<html><body><div>{menu}</div><p>{' '.join(rng.choices('abcdefg', k=12))} {i}</p><div>{menu}</div></body></html>") for i in range(6)]
    rows += [(30, "http://h.example/a", "<body><nav>n</nav><article><h1>T</h1><p>one &amp; two<p>three</article><footer>f</footer></body>")]
    spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, text string").write.parquet(f"{out}/pages.parquet")
    return str(out), rows


def test_warc_query(spark, pages):
    folder, rows = pages
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(i, last.get(h or "", 0))
    got = {r["page_id"]: r for r in QUERIES["op9_warc"](spark, folder).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        data, r = (h or "").encode(), got[i]
        want = last[h or ""]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if want == i else ("revisit", want))


def test_warc_archives(spark, pages, tmp_path):
    archives = warc.write_archives(spark.read.parquet(pages[0] + "/pages.parquet"), min_bytes=5)
    paths = warc.export_archives(archives, str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == [p.rpartition("/")[2] for p in paths] and len(paths) == archives.count()
    for path in paths:
        data = open(path, "rb").read()
        assert data[:4] == (0x184D2A5D).to_bytes(4, "little") and all(x.startswith(b"WARC/1.1\r\n") for x in warc.frames(data))
    back = {r["page_id"]: r for r in warc.read_archives(archives).collect()}
    assert [back[i]["record_type"] for i in (1, 2, 7)] == ["response"] * 3  # four bytes are below min_bytes
    assert back[5]["payload"].decode() == "<p>é" * 3000
    with pytest.raises(ValueError):
        list(warc.frames(b"\0" * 20))


def test_warc_ids_of_text(spark):
    rows = [("a>b\r\n%", "u", "same"), ("", "u", "same"), (None, "u", "same"), ("z é", "u", "other"), (None, None, None)]
    archives = warc.write_archives(spark.createDataFrame(rows, "page_id string, url string, html string"))
    back = [(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_archives(archives, id_type="string").collect()]
    assert sorted(back, key=repr) == sorted([("a>b\r\n%", "response", None), ("", "revisit", "a>b\r\n%"), (None, "revisit", "a>b\r\n%"), ("z é", "response", None), (None, "response", None)], key=repr)


def iso_file(version: int, wide: bool, keys: list[int] | None) -> bytes:
    """An audio track, then a video track of three samples in two chunks, by the format's own definitions."""
    import struct

    box = lambda kind, *parts: struct.pack(">I4s", 8 + sum(map(len, parts)), kind) + b"".join(parts)
    times = struct.pack(">QQIQHH", 1, 2, 600, 7 << 32 | 90, 0, 0) if version else struct.pack(">IIIIHH", 1, 2, 600, 90, 0, 0)
    media = b"AAAAbbbbbbCC"
    brand = box(b"ftyp", b"isom", bytes(4))

    def moov(start: int) -> bytes:
        places = [start, start + 10]
        tables = [
            box(b"stts", bytes(4), struct.pack(">IIIII", 2, 2, 40, 1, 10)),
            box(b"stsc", bytes(4), struct.pack(">IIIIIII", 2, 1, 2, 1, 2, 1, 1)),
            box(b"stsz", bytes(4), struct.pack(">IIIII", 0, 3, 4, 6, 2)),
            box(b"co64", bytes(4), struct.pack(">IQQ", 2, *places)) if wide else box(b"stco", bytes(4), struct.pack(">III", 2, *places)),
        ]
        if keys is not None:
            tables.append(box(b"stss", bytes(4), struct.pack(f">I{len(keys)}I", len(keys), *keys)))
        sound = box(b"stsd", bytes(4), struct.pack(">I", 1), box(b"mp4a", bytes(28)))
        picture = box(b"stsd", bytes(4), struct.pack(">I", 1), box(b"avc1", bytes(24), struct.pack(">HH", 640, 360), bytes(50)))
        track = lambda kind, entry: box(b"trak", box(b"mdia", box(b"mdhd", bytes([version, 0, 0, 0]), times), box(b"hdlr", bytes(8), kind, bytes(13)), box(b"minf", box(b"stbl", entry, *tables))))
        return box(b"moov", track(b"soun", sound), track(b"vide", picture))

    return brand + moov(len(brand) + len(moov(0)) + 8) + box(b"mdat", media)


@pytest.mark.parametrize("version", [0, 1])
@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("keys", [None, [1, 3], []])
def test_foreign_media(spark, version, wide, keys):
    data = iso_file(version, wide, keys)
    info = media.parse_file(data)
    assert (info["codec"], info["width"], info["height"], info["timescale"], info["duration"]) == ("avc1", 640, 360, 600, 90)
    assert [data[a : a + n] for a, n in info["samples"]] == [b"AAAA", b"bbbbbb", b"CC"]
    assert [info["samples"].index(x) + 1 for x in info["keys"]] == (keys if keys is not None else [1, 2, 3])


def test_page_text(spark, pages):
    folder, rows = pages
    got = {r["page_id"]: r["text"] for r in QUERIES["op10_html_text"](spark, folder).collect()}
    assert got[30] == "T\none & two\nthree" and got[3] == got[4] == "" and got[1] == "same"
    for i in range(6):
        assert got[10 + i].endswith(f" {i}") and "imprint" not in got[10 + i]
    assert len(got) == len(rows)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<article><p>a <span class="ad">buy <b>x</b></span> c</p></article>', ["a c"]),
        ("<main><header><h1>H</h1><p>by me</p></header>text<aside>s</aside> more</main>", ["H", "text", "more"]),
        ('<ARTICLE>a<script>if(a<b)"</p>"</script>b<!-- c -->d &lt;x&gt; 1 < 2 &#233;</ARTICLE>', ["abd <x> 1 < 2 é"]),
        ('<body><div class="cookie-notice">c</div><article>x<div id="comments"><article>reply</article></div><form>f</form></article></body>', ["x"]),
        ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article>", ["one", "two", "a", "b"]),
        ("<p>", []),
        ("<article>un<p>closed", ["un", "closed"]),
        ('<article title="a>b">t</article>', ["t"]),
        ("<article>x&nbsp; \n y<br>z</article>", ["x y z"]),
        ('<article><p title="a hidden gem">a</p><p data-id="search">b</p><p data-hidden="false">c</p><p id="share">d</p><h2 id="notice" class="header">e</h2></article>', list("abcde")),
        ('<article><section class="related-work">a</section><section class="related-posts">b</section><div class="article-comments">c</div><div class="leaderboard ads">d</div></article>', ["a"]),
        ("<article>press <button>go</button> and <math><mi>x</mi></math>.<p aria-hidden=true>n</p><p style='Display : none'>n</p><p hidden>n</p></article>", ["press go and x."]),
        ("<div role='MAIN'><p class=\"note shareable\">a</p></div><p>b", ["a"]),
        ('<article><p class="cookie&#45;notice">n</p><p class=adminNote>a</p><p class="navMenu">n</p></article>', ["a"]),
    ],
)
def test_blocks(page, want):
    assert html_text.blocks(page)[1] == want


def test_repeated_runs_match_brute_force():
    rng = random.Random(2)
    for _ in range(20):
        streams = [[rng.choice("abc") for _ in range(rng.randint(0, 30))] for _ in range(5)]
        pages = [0, 1, 2, 2, 3]
        words = [w for s in streams for w in s]
        if not words:
            continue
        got = html_text.repeated(pages, list(map(len, streams)), words, 5).tolist()
        where = {}
        for p, s in zip(pages, streams, strict=True):
            for i in range(len(s) - 4):
                where.setdefault(tuple(s[i : i + 5]), set()).add(p)
        want = []
        for s in streams:
            cover = [False] * len(s)
            for i in range(len(s) - 4):
                if len(where[tuple(s[i : i + 5])]) > 1:
                    cover[i : i + 5] = [True] * 5
            want += cover
        assert got == want


def test_repeats_of_large_hosts(spark):
    """A host with more pages than a task takes loses the runs that two of its pages share, and no others."""
    rng = random.Random(9)
    own = lambda: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(12))
    notices, bodies = [own() for _ in range(20)], [own() for _ in range(600)]
    rows = [(i, f"http://big.example/{i}", f"<body><p>{bodies[i]}</p><div>{notices[i % 20] if i < 40 else ''}</div></body>") for i in range(600)]
    rows += [(0, *rows[0][1:]), (700, "http://small.example/", f"<body><p>{notices[0]}</p></body>")]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == sorted([*enumerate(bodies), (0, bodies[0]), (700, notices[0])])


def test_segments():
    """All maximal scoring segments: disjoint, the best one included, none extendable to a better one."""
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 40)
        hits = [(i, rng.uniform(0.2, 3)) for i in range(n) if rng.random() < 0.3]
        scores = [-0.5] * n
        for i, s in hits:
            scores[i] = s
        found = toxicity.segments(hits, 0.5)
        best = max((sum(scores[a:b]) for a in range(n) for b in range(a + 1, n + 1)), default=0)
        if hits:
            assert max(s for _, _, s in found) == pytest.approx(best)
        assert all(sum(scores[a:b]) == pytest.approx(s) for a, b, s in found)
        ordered = sorted(found)
        assert all(x[1] <= y[0] for x, y in zip(ordered, ordered[1:], strict=False))
        assert {i for i, _ in hits} == {i for a, b, _ in found for i in range(a, b) if scores[i] > 0}


@pytest.mark.skipif(not os.path.isdir(TEST_DATA), reason="needs the driver's tables")
def test_toxicity_on_held_out_rows(spark):
    scored = QUERIES["op8_toxicity"](spark, TEST_DATA)
    rows = scored.join(spark.read.parquet(f"{TEST_DATA}/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows)
    assert right / len(rows) > 0.93
    clean = [r for r in rows if not r["toxic"]]
    assert sum(r["predicted"] for r in clean) / len(clean) < 0.03


def test_toxicity_awkward_rows(spark, folder):
    rows = QUERIES["op8_toxicity"](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count() and all(0 <= r["score"] <= 1 for r in rows)
    model = toxicity.Model(share=0.0)
    assert toxicity.score(spark.createDataFrame([(None,), ("",)], "text string"), model).where("score = 0").count() == 2


corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline_near_copies(spark, folder):
    """Copies at 41 of 51 shingles of 5 words (4-word shingles: 43 of 51)."""
    words = [f"w{i}" for i in range(50)]
    other = words[:25] + ["changed"] + words[26:]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, "apart from both")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.jaccard_join(spark, docs, folder).collect()) == [1, 3]


def test_pipeline_stages(spark, folder, texts):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    all_rows = docs.count()
    kept = corpus_pipeline.jaccard_join(spark, docs, folder)
    found = QUERIES["op4_ngram_jaccard"](spark, folder).where("doc_id = component_id").select("doc_id").distinct().count()
    assert kept.columns == docs.columns and kept.count() == found < all_rows
    clean = corpus_pipeline.benchmark(spark, docs, folder)
    hit = QUERIES["op1_decontamination"](spark, folder).where("contaminated").count()
    assert clean.columns == docs.columns and clean.count() == all_rows - hit < all_rows
    cleared = corpus_pipeline.secrets(spark, docs, folder)
    assert cleared.columns == docs.columns and cleared.count() == all_rows and cleared.where(F.col("text").contains("AKIA")).count() == 0
    out = corpus_pipeline.run(spark, folder)
    assert 0 < out.count() <= found and out.where("not round_trip").count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "decontaminate", "secrets", "sentencepiece"]


def test_pipeline_against_brute_force(spark, folder, texts, tmp_path):
    """All five stages by plain loops, over rows whose ids repeat or are null as well; only the fitted toxicity model is the
    operator's, scored here text by text."""
    from brute import redacted
    from test_text_operators import brute_components

    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    extra = [(7, texts[60][1]), (7, "not like the other seven " * 3), (None, texts[3][1] + " end"), (None, None), (200, f"{texts[1][1]} {' '.join(texts[40][1].split()[32:52])}"), (201, dict(texts)[100])]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts + extra]
    out = tmp_path / "sf"
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{out}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{out}/{name}.parquet")
    model = toxicity.fit(spark.read.parquet(f"{out}/documents.parquet"), spark.read.parquet(f"{out}/labels.parquet"))

    def toxic(text):
        length, found = toxicity.passages((text or "").encode(), model)
        return (toxicity.probability(model.weights, toxicity.features(length, found)) if model.weights else model.share) >= 0.5

    kept = [(i, t) for i, t, *_ in rows if not toxic(t)]
    groups = {}
    for k, ((i, t), (_, _, component)) in enumerate(zip(kept, brute_components([(k, t) for k, (_, t) in enumerate(kept)], 5, 80), strict=True)):
        groups.setdefault(component, []).append((i is None, i, t or "", k))
    kept = [kept[min(g)[3]] for g in groups.values()]
    items = [r["text"] for r in spark.read.parquet(f"{out}/benchmark.parquet").collect()]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = {tuple(w[i : i + 10]) for w in map(words, items) for i in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(w) for w in windows}
    has = lambda w: any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    kept = [(i, None if t is None else redacted(t)) for i, t in kept if not has(words(t))]
    want = sorted(((i, t, library.encode(t or "")) for i, t in kept), key=repr)
    got = corpus_pipeline.run(spark, str(out)).collect()
    assert sorted(((r["doc_id"], r["text"], list(r["ids"])) for r in got), key=repr) == want
    assert all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) for r in got) and len(want) < len(rows)
