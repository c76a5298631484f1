"""Plain loops that tests hold operators against."""

import re


def secret_spans(text, scope=256):
    """(start, kind, end) of strong parts and of weak ones that stand within ``scope`` of what completes them, by plain loops."""
    low = "a-z"
    word = "(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c in "abcdefghijklmnopqrstuvwxyz" else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
    assign = [(m.start(), m.end()) for m in re.finditer(word + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6]
    access = [(m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    hexes = [(m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    near = lambda at, parts: any(abs(at - a) <= scope for a, _ in parts)
    runs = [(m.start(), m.end()) for m in re.finditer("[A-Za-z0-9+/]+", text) if len(m[0]) == 40 and all(re.search(c, m[0]) for c in ("[0-9]", "[A-Z]", f"[{low}]"))]
    links = [(m.start(), m.end()) for m in re.finditer(r"""https?://[A-Za-z0-9.-]+(?::[0-9]+)?[^\x00-\x20"'<>]*""", text)]
    kinds = [assign, access, hexes, [x for x in runs if near(x[0], access)], [x for x in links if near(x[0], access + assign)]]
    return sorted((a, k, z) for k, parts in enumerate(kinds) for a, z in parts)


def redacted(text, names=("assign", "access", "hex", "key", "endpoint")):
    out, at = [], 0
    for a, k, z in secret_spans(text):
        if a >= at:
            out += [text[at:a], f"[{names[k]}]"]
        at = max(at, z)
    return "".join(out) + text[at:]
