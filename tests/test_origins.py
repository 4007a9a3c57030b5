"""Origin maps against slices of the texts themselves."""

import random

from loreforge.operators import origins

CODECS = {"utf-8": "utf-8", "utf-16le": "utf-16-le", "ccsid:1200": "utf-16-be", "cp037": "cp037", "ascii": "ascii"}


def _members(rng, count):
    out = {}
    for k in range(count):
        name = rng.choice(list(CODECS))
        signs = "ab c\n" if name == "ascii" else "aé ñ\n\rxyz" if name == "cp037" else "aé\n\r中\U0001f600 b"
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 60)))
        mark = b"\xff\xfe" if name == "utf-16le" and rng.random() < 0.5 else b""
        out[f"m{k}"] = text, mark, name
    return out


def _expand(name, members, includes):
    """The expanded text as (member, offset) of each of its characters."""
    out, at = [], 0
    for start, stop, included in sorted(includes.get(name, [])):
        out += [(name, i) for i in range(at, start)] + _expand(included, members, includes)
        at = stop
    return out + [(name, i) for i in range(at, len(members[name][0]))]


def _position(text, offset):
    line, start, i = 1, 0, 0
    while i < offset:
        step = 2 if text.startswith("\r\n", i) else 1
        if text[i] in "\r\n" and i + step <= offset:
            line, start = line + 1, i + step
        i += step
    return line, start


def test_spans_come_back_from_the_raw_bytes(spark):
    rng = random.Random(12)
    members = _members(rng, 24)
    includes = {}
    for k in range(20):  # later members are included by earlier ones: no cycles
        text, at, rows = members[f"m{k}"][0], 0, []
        while len(rows) < 2 and at < len(text) and rng.random() < 0.7:
            start = rng.randint(at, len(text))
            stop = min(len(text), start + rng.randint(0, 4))
            rows.append((start, stop, f"m{rng.randint(k + 1, 23)}"))
            at = stop + 1
        includes[f"m{k}"] = rows
    frame = spark.createDataFrame([(m, bytearray(mark + t.encode(CODECS[e])), e) for m, (t, mark, e) in members.items()], "member string, content binary, encoding string")
    sizes = spark.createDataFrame([(m, len(t)) for m, (t, _, _) in members.items()], "member string, chars long")
    links = spark.createDataFrame([(m, a, b, i) for m, rows in includes.items() for a, b, i in rows], "member string, start long, stop long, included string")
    roots = [f"m{k}" for k in range(6)]
    expanded = {r: _expand(r, members, includes) for r in roots}
    segments = origins.expanded_segments(sizes, links, spark.createDataFrame([(r,) for r in roots], "member string")).collect()
    for r in roots:
        got = [None] * len(expanded[r])
        for s in (s for s in segments if s.root == r):
            for i in range(s.start, s.stop):
                assert got[i] is None
                got[i] = s.member, s.source_start + i - s.start
        assert got == expanded[r]
    spans = []
    for r in roots:
        for _ in range(12):
            a = rng.randint(0, max(0, len(expanded[r]) - 1))
            spans.append((len(spans), r, a, rng.randint(a, min(len(expanded[r]), a + 30))))
    table = spark.createDataFrame(segments, "root string, start long, stop long, member string, source_start long, trail array<long>")
    runs = origins.character_runs(frame)
    found = origins.span_origins(spark.createDataFrame(spans, "span long, root string, start long, stop long"), table, runs, 16).orderBy("span", "at").collect()
    for ident, r, a, b in spans:
        want = expanded[r][a:b]
        mine = [f for f in found if f.span == ident]
        assert [(f.member, i) for f in mine for i in range(f.source_start, f.source_stop)] == want
        for f in mine:
            text, mark, encoding = members[f.member]
            piece = text[f.source_start : f.source_stop]
            raw = mark + text.encode(CODECS[encoding])
            assert raw[f.byte_start : f.byte_stop].decode(CODECS[encoding]) == piece
            assert text.encode()[f.decoded_start : f.decoded_stop].decode() == piece
            line, start = _position(text, f.source_start)
            assert (f.start_line, f.start_column) == (line, f.source_start - start + 1)


def test_what_cannot_be_decoded_and_what_is_empty(spark):
    rows = [("a", b"\xfe\xffab", "utf-16le"), ("b", b"\xff", "utf-8"), ("c", b"x", "ccsid:9"), ("d", None, "utf-8"), ("e", b"", "utf-8")]
    got = origins.character_runs(spark.createDataFrame([(m, None if c is None else bytearray(c), e) for m, c, e in rows], "member string, content binary, encoding string")).collect()
    assert [(r.member, r.status) for r in sorted(got)] == [("a", "BOM_MISMATCH"), ("b", "INVALID_ENCODING"), ("c", "UNSUPPORTED_ENCODING"), ("d", "UNSUPPORTED_ENCODING"), ("e", "accepted")]


def test_runs_are_as_few_as_the_text_changes(spark):
    text = ("x" * 5000 + "é" * 3000 + "\n") * 3
    got = origins.character_runs(spark.createDataFrame([("m", bytearray(text.encode()), "utf-8")], "member string, content binary, encoding string")).collect()
    assert len(got) == 9 and sum(r.stop - r.start for r in got) == len(text)


def test_include_cycles_are_refused(spark):
    sizes = spark.createDataFrame([("a", 5), ("b", 5)], "member string, chars long")
    links = spark.createDataFrame([("a", 1, 2, "b"), ("b", 1, 2, "a")], "member string, start long, stop long, included string")
    try:
        origins.expanded_segments(sizes, links, sizes.select("member")).collect()
        raise AssertionError
    except ValueError as error:
        assert str(error) == "INCLUDE_CYCLE"
