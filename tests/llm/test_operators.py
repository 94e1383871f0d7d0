"""Defined cases and plain versions of the ten operators."""

import io
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, IsNull, Not, StringStartsWith

from quarrylake.llm import decontaminate, lines, ngramjoin, packing, pii, quality, queries, repetition, substrings, toxicity, warc
from quarrylake.llm import textkit as K

from . import brute

#: Columns whose names clash with those that operators make.
EXTRA = ["bucket", "score", "n_words", "contaminated", "line_drop", "drop_id", "tile", "h", "label", "start", "n_tokens", "batch", "kind", "payload"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in EXTRA)


def prose(r: random.Random, n: int, vocabulary: int = 4000) -> str:
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "en", None, len(t) if t else None, *["x"] * len(EXTRA)) for d, t in docs], SCHEMA)


def base_docs():
    r = random.Random(5)
    long = prose(r, 20000)
    return [(1, prose(r, 80)), (2, None), (3, ""), (4, " \n\n "), (5, "one"), (6, long), (7, prose(r, 60) + "\n" + prose(r, 40)), (8, "é ß 漢字 🙂 \x00 end")]


CASES = {
    "docs": lambda spark: frame(spark, base_docs()),
    "repeated rows": lambda spark: frame(spark, base_docs() * 3),
    "null ids": lambda spark: frame(spark, [(None, t) for _, t in base_docs()] + base_docs()),
    "empty": lambda spark: frame(spark, []),
    "only nulls": lambda spark: frame(spark, [(None, None), (1, None)]),
}


@pytest.fixture(scope="module")
def benchmark(spark):
    r = random.Random(9)
    return spark.createDataFrame([(1, prose(r, 30)), (2, None), (None, prose(r, 12)), (3, "two words"), (4, "")], "item_id bigint, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (7, 0, 1), (None, 1, 1), (99, 0, 1), (1, None, None), (6, 1, 0)], "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("case", CASES)
def test_defined_cases(spark, benchmark, labels, case):
    docs = CASES[case](spark)
    rows = docs.count()
    # filters keep the columns and never invent rows
    for out in (repetition.keep_unrepetitive(docs), lines.without_repeated_lines(docs), ngramjoin.one_of_each_group(docs), decontaminate.without_benchmark(docs, benchmark)):
        assert out.columns == docs.columns
        assert out.count() <= rows
    assert decontaminate.without_benchmark(docs, benchmark).count() == rows
    assert packing.pack(docs).count() == rows
    assert repetition.repetition_report(docs).count() == rows
    assert pii.identifiers(docs).count() == 0
    assert ngramjoin.links(docs).count() == rows
    spans = substrings.repeated_spans(docs).collect()
    # a passage of a repeated row is one that occurs twice
    assert {r.doc_id for r in spans} == {"docs": set(), "empty": set(), "only nulls": set(), "repeated rows": {1, 6, 7}, "null ids": {1, 6, 7, None}}[case]
    good = quality.good_documents(docs, labels)
    assert {r.doc_id for r in good.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
    toxic = toxicity.toxic_documents(docs, labels.filter("toxic = 0"))
    assert toxic.count() == 0


def test_one_class_keeps_all(spark, labels):
    docs = frame(spark, base_docs())
    got = quality.good_documents(docs, labels.filter("quality = 1"))
    assert {r.doc_id for r in got.collect()} == {1, 5, 6, 7, 8}
    assert {r.score for r in got.collect()} == {1.0}


# 1: WARC


def pages(spark):
    r = random.Random(2)
    rows = [(i, f"http://x.org/{i}", "<p>é " + prose(r, 50)) for i in range(40)]
    rows += [(100, None, "<p>no url"), (101, "http://x.org/null", None), (102, "http://x.org/\r\nodd ", ""), (None, "u", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"), (0, "http://x.org/0", "again"), (0, "http://x.org/0", "again")]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_warc_round_trip(spark):
    df = pages(spark).withColumn("headers", F.lit("clash"))
    key = lambda rows: sorted((str(r.page_id), str(r.url), str(r.html)) for r in rows)
    assert key(warc.written_and_read(df).collect()) == key(df.collect())
    assert warc.written_and_read(df.limit(0)).count() == 0


def test_warc_pushdown(spark, tmp_path):
    warc.register(spark)
    path = f"file://{tmp_path}/w"
    warc.page_records(pages(spark)).write.format("warc").mode("append").option("fileBytes", "2000").save(path)
    everything = spark.read.format("warc").load(path)
    assert everything.count() == 2 * 46
    # a file that no task has committed is not read
    (tmp_path / "w/part-lost.warc.gz").write_bytes(b"\x1f\x8bbroken")
    assert everything.filter("warc_type = 'request'").count() == 46
    assert everything.filter("http_status = 200 and target_uri like 'http://x.org/1%'").count() == 11
    assert everything.filter("target_uri is null").count() == 2
    assert everything.filter("not warc_type in ('response')").count() == 46
    assert spark.read.format("warc").option("payload", "false").load(path).filter("payload is not null").count() == 0
    reader = warc.WarcReader({"path": path})
    left = list(reader.pushFilters([EqualTo(("warc_type",), "response"), StringStartsWith(("target_uri",), "http://x.org/3"), EqualTo(("payload",), "x"), EqualTo(("http_status",), 200)]))
    assert [f.attribute for f in left] == [("payload",)] and len(reader.warc_filters) == 2 and len(reader.http_filters) == 1
    plan = spark.read.format("warc").load(path).filter("warc_type = 'response'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [EqualTo(warc_type,response)" in plan or "warc_type" in plan.split("PushedFilters")[-1]


def test_warc_nulls_in_filters():
    get = {"target_uri": None, "warc_type": "response"}.get
    assert not warc.compare(EqualTo(("target_uri",), "x"), get)
    assert not warc.compare(Not(EqualTo(("target_uri",), "x")), get)
    assert warc.compare(IsNull(("target_uri",)), get) and not warc.compare(Not(IsNull(("target_uri",))), get)
    assert warc.compare(Not(In(("warc_type",), ("a",))), get)


def test_warc_plain_and_foreign_files(spark, tmp_path):
    record = lambda kind, body: b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nX-Folded: a\r\n b\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    parts = [record(b"warcinfo", b"software: x"), record(b"response", b"caf\xe9"), record(b"response", b"")]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    gz = b""
    for p in parts:  # members without skip lengths
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        gz += z.compress(p) + z.flush()
    (tmp_path / "b.warc.gz").write_bytes(gz)
    warc.register(spark)
    got = spark.read.format("warc").load(str(tmp_path)).filter("warc_type = 'response'").collect()
    assert sorted(r.payload for r in got) == ["", "", "café", "café"]
    assert got[0].headers["X-Folded"] == "a b"
    (tmp_path / "c.warc").write_bytes(parts[1][:-9])
    with pytest.raises(Exception, match="breaks off"):
        spark.read.format("warc").load(f"{tmp_path}/c.warc").collect()


def test_warc_members_of_many_records(spark, tmp_path):
    record = lambda kind, body: b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    bodies = [b"a" * 10, b"b" * 100_000, b"", b"WARC/1.0\r\n\r\n", b"c" * 3]
    parts = [record(b"response" if k % 2 else b"request", b) for k, b in enumerate(bodies)]
    foreign = lambda x: (z := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(x) + z.flush()
    (tmp_path / "a.warc.gz").write_bytes(foreign(b"".join(parts)))
    (tmp_path / "b.warc.gz").write_bytes(foreign(b"".join(parts[:2])) + foreign(parts[2]) + foreign(b"".join(parts[3:])))
    (tmp_path / "c.warc.gz").write_bytes(warc.member(b"".join(parts), 6) + warc.member(parts[0], 6))
    warc.register(spark)
    for name, more in (("a", []), ("b", []), ("c", bodies[:1])):
        df = spark.read.format("warc").load(f"{tmp_path}/{name}.warc.gz")
        assert sorted(r.payload for r in df.collect()) == sorted(b.decode() for b in bodies + more)
        assert sorted(r.payload for r in df.filter("warc_type = 'response'").collect()) == sorted(b.decode() for b in bodies[1::2])
        assert spark.read.format("warc").option("payload", "false").load(f"{tmp_path}/{name}.warc.gz").count() == 5 + len(more)
    for k, broken in enumerate([b"WARC/1.0\r\nWARC-Type: x\r\n", parts[0] + parts[1][:30], parts[0] + parts[1][:-9]]):
        (tmp_path / f"{k}.warc.gz").write_bytes(foreign(broken))
        with pytest.raises(Exception, match="breaks off"):
            spark.read.format("warc").load(f"{tmp_path}/{k}.warc.gz").collect()


def test_warc_names_in_any_case(spark, tmp_path):
    record = lambda body: b"WARC/1.0\r\nwarc-type: response\r\ncontent-type: Application/x\r\ncontent-length: " + str(len(body)).encode() + b"\r\nCONTENT-LENGTH: 999\r\nWarc-Target-Uri: u\r\n\r\n" + body + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record(b"one") + record(b"") + record(b"three"))
    warc.register(spark)
    got = spark.read.format("warc").load(f"{tmp_path}/a.warc").filter("warc_type = 'response' and target_uri = 'u'").collect()
    assert [(r.payload, r.content_length, r.content_type) for r in got] == [("one", 3, "Application/x"), ("", 0, "Application/x"), ("three", 5, "Application/x")]
    assert got[0].headers == {"warc-type": "response", "content-type": "Application/x", "content-length": "3", "Warc-Target-Uri": "u"}


def test_warc_cut_files(spark, tmp_path):
    """Wherever a file is cut, but between records, there is an error, for records that nobody wants, too."""
    record = lambda kind, body: b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    parts = [record(b"response", b"x" * 50), record(b"request", b"y" * 70)]
    foreign = lambda x: (z := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(x) + z.flush()
    read = lambda data, gz: [f.of("warc-type") for f, _ in warc.records(io.BytesIO(data), lambda f: f.of("WARC-Type") == "response", gz)]
    for whole, first, gz in ((b"".join(parts), len(parts[0]), False), (foreign(parts[0]) + foreign(parts[1]), len(foreign(parts[0])), True), (warc.member(parts[0], 6) + warc.member(parts[1], 6), len(warc.member(parts[0], 6)), True)):
        assert read(whole, gz) == ["response"]
        for n in range(first + 1, len(whole)):
            if not gz and (not whole[first:n].strip() or n >= len(whole) - 4):
                continue  # line ends behind a record may be missing
            with pytest.raises(EOFError):
                read(whole[:n], gz)


def test_warc_reads_no_payload_before_its_header_is_judged():
    class Counting(io.BytesIO):
        given = 0

        def read(self, n=-1):
            got = super().read(n)
            self.given += len(got)
            return got

    payload = b"z" * 5_000_000
    body = b"HTTP/1.1 404 gone\r\nContent-type: text/html\r\n\r\n" + payload
    data = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    for options, filters, want in (({}, [EqualTo(("http_status",), 200)], None), ({"payload": "false"}, [EqualTo(("http_status",), 404)], (404, "text/html", None)), ({}, [EqualTo(("http_status",), 404)], (404, "text/html", payload.decode()))):
        reader = warc.WarcReader({"path": "x"} | options)
        assert not list(reader.pushFilters(filters))
        file = Counting(data * 2)
        rows = [reader.row(f, b)[0] for f, b in warc.records(file, lambda f: True, False)]
        assert len(rows) == 2 and [r and (r[6], r[7], r[9]) for r in rows] == [want, want]
        assert file.given > 10_000_000 if want and want[2] else file.given < 4 * warc.HEAD


def test_skip_lengths():
    m = warc.member(b"x" * 1000, 3)
    assert struct.unpack("<I", m[16:20])[0] == len(m) and zlib.decompress(m, 31) == b"x" * 1000


# 2: decontamination


def test_decontamination_against_plain(spark):
    r = random.Random(4)
    items = [(i, prose(r, 12 + 2 * i, 200)) for i in range(12)] + [(50, "too short"), (51, None)]
    docs = []
    for d in range(40):
        w = prose(r, 60, 3000).split()
        if d % 2:
            item = r.choice(items[:12])[1].split()
            for _ in range(r.randrange(4)):  # edited copies
                at = r.randrange(len(item))
                item[at : at + 1] = r.choice([[], ["new"], [item[at], "in"]])
            at = r.randrange(len(w))
            w[at:at] = item
        docs.append((d, " ".join(w)))
    docs += [(90, None), (91, "")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = [(x.doc_id, x.item_id, x.score, x.end_word) for x in decontaminate.contaminated(frame(spark, docs), bench).collect()]
    assert sorted(got, key=str) == brute.contaminated(docs, items)
    kept = {x.doc_id for x in decontaminate.without_benchmark(frame(spark, docs), bench).collect()}
    assert kept == {d for d, _ in docs} - {x[0] for x in got}


def test_decontamination_keeps_seeds_of_popular_items(spark):
    item = prose(random.Random(1), 20)
    docs = frame(spark, [(d, f"before {item} after {d}") for d in range(3000)])
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    assert decontaminate.contaminated(docs, bench).filter("score = 1").count() == 3000


def test_decontamination_of_thinned_copies(spark, monkeypatch):
    """Copies with each third word replaced have no trigram of the item; slices and more documents change nothing."""
    r = random.Random(6)
    items = [(i, prose(r, r.randrange(20, 50), 300)) for i in range(20)]
    thin = lambda t, k: " ".join("other%d" % j if j % 3 == k else w for j, w in enumerate(t.split()))
    docs = [(d, prose(r, 40) + " " + thin(items[d % 20][1], d % 2) + " " + prose(r, 40)) for d in range(40)] + [(100 + d, prose(r, 100, 300)) for d in range(100)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    find = lambda docs: sorted((x.doc_id, x.item_id, x.score, x.end_word) for x in decontaminate.contaminated(frame(spark, docs), bench).collect())
    got = find(docs)
    assert got == sorted(brute.contaminated(docs, items))
    assert {x[0] for x in got} >= set(range(1, 40, 2))
    monkeypatch.setattr(decontaminate, "SLICE_WORDS", 200)
    assert len(list(decontaminate.slices(bench, "item_id", "text"))) > 1
    assert find(docs) == got
    assert {x.doc_id for x in decontaminate.without_benchmark(frame(spark, docs), bench).collect()} == {d for d, _ in docs} - {x[0] for x in got}
    assert [x for x in find(docs + [(1000 + d, prose(r, 60, 300)) for d in range(300)]) if x[0] < 1000] == got


def test_decontamination_of_odd_rows(spark):
    r = random.Random(7)
    item, long = prose(r, 25), prose(r, 30000)
    docs = [(None, "x " + item), (1, item.upper()), (1, item), (2, long[:60000] + " " + item + " " + long[60000:]), (3, item + " " + item), (4, None)]
    bench = spark.createDataFrame([(7, item), (7, item), (None, item), (8, None), (9, "two words")], "item_id bigint, text string")
    got = sorted(((x.doc_id, x.item_id, x.score) for x in decontaminate.contaminated(frame(spark, docs), bench).collect()), key=str)
    assert got == sorted([(d, i, 1.0) for d in (None, 1, 1, 2, 3) for i in (7, 7, None)], key=str)
    assert [x.doc_id for x in decontaminate.without_benchmark(frame(spark, docs), bench).collect()] == [4]


# 3: line dedup


def edited(r: random.Random, line: str, n: int) -> str:
    for _ in range(n if line else 0):
        at = r.randrange(max(1, len(line)))
        line = line[:at] + r.choice(["", "z", line[at : at + 1] + "y"]) + line[at + 1 :]
    return line


def test_lines_against_plain(spark):
    r = random.Random(8)
    pool = ["".join(r.choice("abcde é") for _ in range(r.randrange(18, 60))) for _ in range(25)]
    docs = [(d, "\n".join(edited(r, r.choice(pool), r.choice([0, 0, 1, 2, 3])) for _ in range(r.randrange(1, 6)))) for d in range(60)]
    got = {(x.doc_id, x.line, x.first_doc_id, x.first_line, x.edits) for x in lines.repeated_lines(frame(spark, docs)).collect()}
    assert got == brute.repeated_lines(docs)
    left = [(x.doc_id, x.text) for x in lines.without_repeated_lines(frame(spark, docs)).collect()]
    assert sorted(left) == sorted(brute.without_lines(docs))


def plain_short_lines(docs):
    """As brute.repeated_lines, for lines of every length."""
    places = {}
    for d, t in docs:
        for n, line in enumerate(t.split("\n")):
            if line.strip():
                places.setdefault(line.encode(), []).append((d, n))
    order, out = sorted(places, key=lambda x: places[x][0]), set()
    for k, b in enumerate(order):
        most = lambda a: min(2, len(a) // 10, len(b) // 10)  # noqa: E731, B023
        near = next(((a, e) for a in order[:k] if abs(len(a) - len(b)) <= most(a) and (e := brute.edits(a, b)) <= most(a)), None)
        out |= {(*p, *places[near[0]][0], near[1]) for p in places[b]} if near else {(*p, *places[b][0], 0) for p in places[b][1:]}
    return out


@pytest.mark.parametrize("local", [True, False])
def test_short_lines_against_plain(spark, monkeypatch, local):
    if not local:
        monkeypatch.setattr(lines, "BLOOM_BITS", 1 << 16)
        monkeypatch.setattr(lines, "EACH", 1 << 10)
    r = random.Random(22)
    pool = ["".join(r.choice("abcdé ") for _ in range(n)) for n in (*range(0, 24), 9, 10, 11, 18, 19, 20, 21)]
    docs = [(d, "\n".join(edited(r, r.choice(pool), r.choice([0, 0, 1, 2])) for _ in range(r.randrange(1, 8)))) for d in range(60)]
    docs += [(90, "Les.\n \n1.\n2."), (91, "Les.\n \n\t\n3.\nx"), (92, " \nLes.")]
    got = {(x.doc_id, x.line, x.first_doc_id, x.first_line, x.edits) for x in lines.repeated_lines(frame(spark, docs)).collect()}
    assert got == plain_short_lines(docs) and {(91, 0, 90, 0, 0), (92, 1, 90, 0, 0)} <= got
    assert {e for *_, e in got} == {0, 1, 2}
    assert {x.doc_id: x.text for x in lines.without_repeated_lines(frame(spark, docs[-3:])).collect()} == {90: "Les.\n \n1.\n2.", 91: " \n\t\n3.\nx"}


def test_lines_through_the_join(spark, monkeypatch):
    """The way for lakes whose meetings can't be held in memory gives the same."""
    r = random.Random(3)
    pool = [prose(r, 8) for _ in range(10)]
    docs = [(d, "\n".join(edited(r, r.choice(pool), r.choice([0, 1, 2])) for _ in range(3))) for d in range(30)]
    monkeypatch.setattr(lines, "bloom", lambda needed: np.full(1 << 13, 255, np.uint8))
    got = {(x.doc_id, x.line, x.first_doc_id, x.first_line, x.edits) for x in lines.repeated_lines(frame(spark, docs)).collect()}
    assert got == brute.repeated_lines(docs)


def test_banded_distance():
    r = random.Random(6)
    pairs = []
    for _ in range(300):
        a = "".join(r.choice("ab") for _ in range(r.randrange(0, 12)))
        b = edited(r, a, r.randrange(4)) if a else a
        if len(a) < len(b):
            a, b = b, a
        if len(a) - len(b) <= lines.EDITS:
            pairs.append((a.encode(), b.encode()))
    data = np.frombuffer(b"".join(a + b for a, b in pairs) + bytes(8), np.uint8)
    at = np.r_[0, np.cumsum([x for a, b in pairs for x in (len(a), len(b))])]
    got = lines.within(data, (at[:-1:2], at[1::2]), (at[1:-1:2], at[2::2]))
    assert got.tolist() == [min(brute.edits(a, b), lines.EDITS + 1) for a, b in pairs]


# 4: PII


def pii_docs():
    r = random.Random(12)
    docs = [(i, prose(r, 30)) for i in range(30)]
    for i in range(12):
        docs.append((100 + i, f"{prose(r, 5)} mail bob.{i}@mail{i}.example.com and call +1 ({200 + i}) 555-{1000 + i} now {prose(r, 5)}"))
        docs.append((200 + i, f"host 10.{i}.3.{i + 1}, password=ab{i:02d}cdefgh0123456789 end"))
    docs += [(300, "card 4111111111111111 ok"), (301, "card 4111111111111112 ok"), (302, "card 4012888888881881 ok"), (303, "card 5555555555554444 ok"), (304, "card 378282246310005 x"), (305, "License, Version 4.0. of 2024-01-02")]
    return docs


def test_pii(spark):
    docs = pii_docs()
    got = pii.identifiers(frame(spark, docs)).collect()
    text = dict(docs)
    found = {(r.doc_id, r.kind, text[r.doc_id][r.start : r.end]) for r in got}
    for i in range(12):
        assert {(100 + i, "email", f"bob.{i}@mail{i}.example.com"), (100 + i, "phone", f"+1 ({200 + i}) 555-{1000 + i}"), (200 + i, "ip", f"10.{i}.3.{i + 1}"), (200 + i, "secret", f"password=ab{i:02d}cdefgh0123456789")} <= found
    # the check digit is wrong; what it looks like and the word before it tell
    assert (301, "card", "4111111111111112") in found and not next(r for r in got if r.doc_id == 301).seed
    assert {r.doc_id for r in got} & {*range(30), 305} == set()


def test_pii_finds_what_was_put_in(spark):
    """Spans of what is put into texts at known places; null ids, repeated rows and a long text."""
    r = random.Random(15)
    make = {
        "email": lambda: f"{r.choice('abc')}{r.randrange(10**6)}.x@host{r.randrange(99)}.example.org",
        "ip": lambda: ".".join(str(r.randrange(1, 256)) for _ in range(4)),
        "secret": lambda: "token=" + "".join(r.choice("abcdef0123456789") for _ in range(300)) + "a1",
        "phone": lambda: f"+1 ({r.randrange(200, 999)}) {r.randrange(200, 999)}-{r.randrange(1000, 9999)}",
    }
    docs, want = [], []
    for d in [*range(12), None, None]:
        text = ""
        for _ in range(6):
            kind = r.choice(list(make))
            text += prose(r, 2000 if d == 3 else 4, 50).replace("w", "word ").replace("1", "one").translate(str.maketrans("023456789", "abcdefghi")) + " "
            value = make[kind]()
            want.append((d, kind, len(text), len(text) + len(value)))
            text += value + " "
        docs.append((d, text))
    docs.append(docs[5])
    want += [x for x in want if x[0] == 5]
    got = [(x.doc_id, x.kind, x.start, x.end) for x in pii.identifiers(frame(spark, docs)).collect() if x.seed]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_pii_candidates_are_whole():
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9P"
    found = lambda t: [(kind, value) for _, _, kind, value, *_ in pii.candidates(t)]
    for value in ("ab1" * 120, jwt, "a1" * 400, "Pass.w0rd&more!and=99"):
        assert found(f"x token={value} y") == [("pair", f"token={value}")] == found(f"x token={value}. y")
        assert found(f'x token="{value}" y') == [("pair", f'token="{value}"')]
    assert found(f"key {'0f' * 64} end") == [("code", "0f" * 64)]
    assert found("user=bob12345&token=abcdefgh12345678, ok") == [("pair", "user=bob12345"), ("pair", "token=abcdefgh12345678")]
    assert found("mail:bob7@mail7.example.com ip:10.20.30.40") == [("mail", "bob7@mail7.example.com"), ("quad", "10.20.30.40")]
    assert found("see https://x.org/?token=abcdefgh12345678 id=12345,k=1")[0] == ("pair", "token=abcdefgh12345678")


def test_pii_against_plain(spark):
    docs = pii_docs() * 2
    got = {(r.doc_id, r.kind, r.start, r.end, r.score, r.seed) for r in pii.identifiers(frame(spark, docs)).collect()}
    seen, edges, seeds = [], {}, {}
    for d, t in docs:
        for s, e, kind, value, before, after in pii.candidates(t):
            inst = (kind, value.lower())
            seeds[inst] = pii.seed_of(kind, value)
            seen.append((d, s, e, inst))
            for p in pii.patterns_of(kind, value, before, after):
                edges.setdefault(p, set()).add(inst)
    edges = {p: x for p, x in edges.items() if len(x) >= pii.SUPPORT}
    score = {(i, k): 1.0 for i, k in seeds.items() if k}
    kinds = {k for _, k in score}
    for _ in range(pii.ROUNDS):
        trust = {(p, k): sum(score.get((i, k), 0) for i in x) / (len(x) + pii.PRIOR) for p, x in edges.items() for k in kinds}
        new = {(i, k): 1.0 for i, k in seeds.items() if k}
        for i, own in seeds.items():
            if not own:
                for k in kinds:
                    best = [max([0, *(trust[p, k] for p, x in edges.items() if i in x and p[1] == shape)]) for shape in (True, False)]
                    if best != [0, 0]:
                        new[i, k] = 1 - (1 - best[0]) * (1 - best[1])
        score = new
    want = set()
    for d, s, e, i in seen:
        if seeds[i]:
            want.add((d, seeds[i], s, e, 1.0, True))
        elif top := sorted((-v, k) for (j, k), v in score.items() if j == i and v >= pii.THRESHOLD):
            want.add((d, top[0][1], s, e, round(-top[0][0], 6), False))
    assert got == want


# 5: substrings


def test_substrings(spark):
    r = random.Random(7)
    passage = prose(r, 70)
    docs = [(1, prose(r, 30) + " " + passage + " " + prose(r, 10)), (2, passage.upper()), (3, passage[: len(passage) // 2]), (4, prose(r, 49) * 1)]
    got = {(x.doc_id, x.start_word, x.end_word, x.n_words) for x in substrings.repeated_spans(frame(spark, docs)).collect()}
    assert got == {(1, 30, 100, 70), (2, 0, 70, 70)}


def test_substrings_are_exact_with_a_full_sketch(spark, monkeypatch):
    """Collisions of the sketch add candidates, and change nothing."""
    r = random.Random(7)
    docs = [(i, prose(r, 80)) for i in range(30)] + [(40, prose(random.Random(1), 120)), (41, prose(random.Random(1), 120))]
    want = {tuple(x) for x in substrings.repeated_spans(frame(spark, docs)).collect()}
    monkeypatch.setattr(substrings, "width_for", lambda words: 1 << 8)
    monkeypatch.setattr(substrings, "BLOCK", 8)
    assert {tuple(x) for x in substrings.repeated_spans(frame(spark, docs)).collect()} == want == {(40, 0, 120, 120), (41, 0, 120, 120)}


# 6: n-gram join


def near_docs(n: int = 60):
    r = random.Random(10)
    out = []
    for d in range(n):
        if d % 3 and out:
            w = r.choice(out)[1].split()
            for _ in range(r.randrange(len(w) // 6 + 1)):
                w[r.randrange(len(w))] = f"n{r.randrange(999)}"
            out.append((d, " ".join(w)))
        else:
            out.append((d, prose(r, r.randrange(2, 60))))
    return out


def plain_links(docs):
    """(doc_id, class_id, links) of each row, and rows by number that are similar."""
    sets = [brute.grams(t) for _, t in docs]
    near = [{j for j in range(len(docs)) if j != i and sets[i] and sets[j] and 2 * len(sets[i] & sets[j]) >= len(sets[i] | sets[j])} for i in range(len(docs))]
    out = []
    for i, (d, _) in enumerate(docs):
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        out.append((d, min((docs[j][0] for j in seen if docs[j][0] is not None), default=None), len(near[i])))
    return sorted(out, key=str)


def links_of(spark, docs):
    return sorted(((x.doc_id, x.class_id, x.links) for x in ngramjoin.links(frame(spark, docs)).collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_join_against_plain(spark, monkeypatch, small):
    if small:  # many buckets, blocks of tiles, portions and no rounds of leaders
        for name, x in (("EACH", 4096), ("BLOCK", 3), ("PAIRS", 50), ("ROUNDS", 1)):
            monkeypatch.setattr(ngramjoin, name, x)
    docs = near_docs()
    assert links_of(spark, docs) == plain_links(docs)
    heads: dict = {}
    for d, t in docs:
        heads.setdefault(brute.grams(t), d)
    want = {(a, b) for a, b in brute.similar(docs) if a in heads.values() and b in heads.values()}
    got = [(x.doc_a, x.doc_b) for x in ngramjoin.similar_pairs(frame(spark, docs)).collect()]
    assert len(got) == len(want) and set(got) == want
    assert [(x.doc_id, x.text) for x in ngramjoin.one_of_each_group(frame(spark, docs)).orderBy("doc_id").collect()] == sorted(brute.one_of_each(docs))


def test_join_at_the_threshold(spark):
    """Pairs that share just as much as they must, or one gram less, at all sizes."""
    r = random.Random(31)
    docs, d = [], 0
    for n in range(3, 60):
        words = [f"u{d}x{i}" for i in range(n)]
        for k in range(0, n):  # the first k words, then others
            if abs((k - 2) - (2 * n - 4 - (k - 2)) / 2) <= 2:
                docs += [(d, " ".join(words)), (d + 1, " ".join(words[:k] + [f"v{d}y{i}" for i in range(r.choice([n - k, n - k + 1]))]))]
                d += 2
                words = [f"u{d}x{i}" for i in range(n)]
    got = links_of(spark, docs)
    assert got == plain_links(docs)
    assert 20 < sum(x[2] for x in got) < 2 * len(docs) - 20


def test_join_counts_copies_and_keeps_odd_ids(spark):
    r = random.Random(21)
    text = prose(r, 40)
    near = text.rsplit(" ", 1)[0] + " other"
    docs = [*((d, text) for d in range(0, 10, 2)), *((d, near) for d in (1, 5, 11)), *((20 + d, prose(r, 40)) for d in range(5)), (30, None), (31, ""), (None, ""), (32, "two words"), (33, "Two, words!"), (34, "word")]
    # ids that stand for two sets, repeated rows, null ids with and without others
    docs += [(11, prose(r, 30)), (1, text), (1, text), (None, text), (None, "all alone here"), (None, "all alone here")]
    got = links_of(spark, docs)
    assert got == plain_links(docs)
    kept = [(x.doc_id, x.text) for x in ngramjoin.one_of_each_group(frame(spark, docs)).collect()]
    alone = docs[-6]  # another text under an id that goes elsewhere
    assert sorted(kept, key=str) == sorted([(0, text), *docs[8:13], *docs[13:17], (34, "word"), alone, *docs[-2:]], key=str)


def test_join_of_hot_grams(spark, monkeypatch):
    """Grams that nearly all documents have, in the list of hot ones, change nothing."""
    r = random.Random(22)
    licence = prose(r, 30)
    docs = [(d, licence + " " + prose(r, r.choice([10, 25, 40]))) for d in range(60)]
    docs += [(100 + d, docs[d][1] + " end") for d in range(20)]
    want = plain_links(docs)
    monkeypatch.setattr(ngramjoin, "hot_grams", lambda sketch: np.sort(np.array([x.f for x in sketch.filter("hot").select("f").distinct().collect()], np.int64).view(np.uint64)))
    assert len(ngramjoin.hot_grams(ngramjoin.sketches(frame(spark, docs).select("doc_id", F.xxhash64("text").alias("fp"), "text")))) >= 28
    assert links_of(spark, docs) == want


def test_components(spark):
    r = random.Random(23)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(50)]
    low = ngramjoin.joined(3000, *np.array(edges).T)
    got = {x.doc_id: x.group for x in ngramjoin.components(spark.createDataFrame(edges, "a bigint, b bigint").filter("a <> b")).collect()}
    assert got == {i: g for i, g in enumerate(low.tolist()) if i != g}
    assert ngramjoin.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_join_over_all_documents_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = [(x.doc_id, x.class_id, x.links) for x in queries.op6_ngram_join(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got, key=str) == plain_links([tuple(x) for x in docs.collect()])


# 7 and 9: the models


def test_network_against_plain():
    r = np.random.default_rng(0)
    net = toxicity.Net.fresh()
    net.word[:], net.tri[:] = r.standard_normal(net.word.shape) * 0.3, r.standard_normal(net.tri.shape) * 0.3
    text = prose(random.Random(1), 70)
    w = K.words(pa.array([text, None, "one two"]))
    row, start, size = toxicity.windows(w.counts, w.ptr)
    assert list(zip(row, start, size)) == [(0, 0, 32), (0, 16, 32), (0, 32, 32), (0, 48, 22), (2, 70, 2)]
    vocab = toxicity.Vocabulary.of(w)
    inputs = vocab.inputs(net)
    got, _ = toxicity.forward(net, toxicity.project(net, inputs), vocab.at, start, size)
    soft = lambda x: x / (1 + np.abs(x))
    H = toxicity.HIDDEN
    for k in range(len(row)):
        x = inputs[vocab.at[start[k] : start[k] + size[k]]]
        out = np.zeros((size[k], 2))
        for d, order in ((0, range(size[k])), (1, range(size[k] - 1, -1, -1))):
            h = np.zeros(H)
            for t in order:
                a, g = x[t] @ net.w[d] + net.b[d], h @ net.u[d]
                z, q = (0.5 + 0.5 * soft(a[i * H : i * H + H] + g[i * H : i * H + H]) for i in (0, 1))
                n = soft(a[2 * H :] + q * g[2 * H :])
                h = (1 - z) * n + z * h
                out[t] += h @ net.head[d]
        a = np.exp(out[:, 0] - out[:, 0].max())
        assert abs((a / a.sum() * out[:, 1]).sum() + net.bias[0] - got[k]) < 1e-4


def test_network_gradient():
    r = np.random.default_rng(0)
    net = toxicity.Net.fresh()
    inputs = (r.standard_normal((9, 2 * toxicity.WIDTH)) * 0.5).astype("f4")
    at = r.integers(0, 9, 64)
    start, size = np.array([0, 32]), np.array([32, 11])
    loss = lambda: float(toxicity.forward(net, toxicity.project(net, inputs), at, start, size)[0].sum())
    _, back = toxicity.forward(net, toxicity.project(net, inputs), at, start, size, keep=True)
    grads, dinputs = toxicity.backward(net, inputs, back, np.ones(2, "f4"))
    for name, value, g in [("u0", net.u[0], grads["u0"]), ("w1", net.w[1], grads["w1"]), ("head1", net.head[1], grads["head1"]), ("b0", net.b[0], grads["b0"]), ("inputs", inputs, dinputs)]:
        at_ = tuple(0 for _ in value.shape)
        old = value[at_]
        value[at_] = old + 0.01
        up = loss()
        value[at_] = old - 0.01
        down = loss()
        value[at_] = old
        assert abs((up - down) / 0.02 - g[at_]) < 2e-3 + 0.05 * abs(g[at_]), name


def test_toxicity_held_out(spark):
    r = random.Random(3)
    bad = ["vile", "rotten", "filthy"]

    def doc(toxic):
        w = prose(r, r.randrange(20, 150), 300).split()
        for _ in range(3 * toxic):
            w.insert(r.randrange(len(w)), r.choice(bad))
        return " ".join(w)

    rows = [(i, i % 4 == 0, doc(i % 4 == 0)) for i in range(600)]
    docs = frame(spark, [(i, t) for i, _, t in rows] + [(900, None), (901, "")])
    labels = spark.createDataFrame([(i, int(y)) for i, y, _ in rows[:400]], "doc_id bigint, toxic int")
    got = {x.doc_id: x for x in toxicity.toxic_documents(docs, labels).collect()}
    test = rows[400:]
    hits = [i in got for i, y, _ in test if y]
    alarms = [i in got for i, y, _ in test if not y]
    assert np.mean(hits) >= 0.9 and np.mean(alarms) <= 0.02
    assert 900 not in got and 901 not in got
    assert all(0 < x.toxic_windows <= x.n_windows for x in got.values())


def toxic_docs(r, n):
    bad = ["vile", "rotten", "filthy"]
    out = []
    for i in range(n):
        w = prose(r, r.randrange(20, 150), 300).split()
        for _ in range(3 * (i % 4 == 0)):
            w.insert(r.randrange(len(w)), r.choice(bad))
        out.append((i, " ".join(w)))
    return out


def plain_window_scores(net, text):
    """A text's windows one by one, word by word."""
    words, H, W = brute.words(text), toxicity.HIDDEN, toxicity.WINDOW
    soft = lambda x: x / (1 + np.abs(x))
    inputs = [toxicity.Vocabulary.of(K.words(pa.array([w]))).inputs(net)[0] for w in words]
    starts = [0]
    while starts[-1] + W < len(words):
        starts.append(starts[-1] + toxicity.STRIDE)
    out = []
    for s in starts if words else []:
        x = inputs[s : s + W]
        both = np.zeros((len(x), 2))
        for d, order in ((0, range(len(x))), (1, range(len(x) - 1, -1, -1))):
            h = np.zeros(H)
            for t in order:
                a, g = x[t] @ net.w[d] + net.b[d], h @ net.u[d]
                z, q = (0.5 + 0.5 * soft(a[i * H : i * H + H] + g[i * H : i * H + H]) for i in (0, 1))
                h = (1 - z) * soft(a[2 * H :] + q * g[2 * H :]) + z * h
                both[t] += h @ net.head[d]
        a = np.exp(both[:, 0] - both[:, 0].max())
        out.append(1 / (1 + np.exp(-((a / a.sum() * both[:, 1]).sum() + net.bias[0]))))
    return out


def test_toxicity_query_against_plain(spark, monkeypatch):
    """A trained network over odd rows: null ids, repeated rows, a long text, clashing columns."""
    r = random.Random(13)
    docs = toxic_docs(r, 160)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in docs] + [(0, 0), (None, 1), (999, 1), (3, None)], "doc_id bigint, toxic int")
    nets, train = [], toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda *a: nets.append(train(*a)) or nets[-1])
    long = prose(r, 1500, 300) + " vile rotten filthy vile " + prose(r, 100, 300)
    docs += [(None, docs[0][1]), (None, docs[1][1]), docs[4], docs[4], (500, long), (501, None), (502, ""), (503, "vile"), (504, "fine")]
    got = sorted(((x.doc_id, x.n_windows, x.toxic_windows, x.score) for x in toxicity.toxic_documents(frame(spark, docs), labels).collect()), key=str)
    net, want = nets[0], []
    for d, t in docs:
        scores = plain_window_scores(net, t)
        assert all(abs(x - net.threshold) > 1e-4 for x in scores)
        if scores and max(scores) >= net.threshold:
            want.append((d, len(scores), sum(x >= net.threshold for x in scores), max(scores)))
    want.sort(key=str)
    assert [x[:3] for x in got] == [x[:3] for x in want] and all(abs(a[3] - b[3]) < 2e-4 for a, b in zip(got, want))
    assert {None, 4, 500} <= {x[0] for x in got} and sum(x[0] == 4 for x in got) == 3 and not {501, 502} & {x[0] for x in got}


def test_toxicity_learns_from_all_labels(spark):
    """A word that only labelled documents beyond the 1000 least by hash have."""
    r = random.Random(17)
    ids = np.arange(2400)
    toxic = ids[ids % 2 == 0]
    late = set(toxic[np.argsort(K.mix(toxic.astype(np.uint64)))[1000:]].tolist())
    word = lambda i: "" if i % 2 else "filthy" if i in late else "vile"
    docs = [(int(i), f"{prose(r, 6, 200)} {word(i)} {prose(r, 6, 200)}") for i in ids]
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i, _ in docs], "doc_id bigint, toxic int")
    new = [(5000 + i, f"{prose(r, 6, 200)} {('filthy', 'vile', '')[i % 3]} {prose(r, 6, 200)}") for i in range(90)]
    got = {x.doc_id - 5000 for x in toxicity.toxic_documents(frame(spark, docs + new), labels).filter("doc_id >= 5000").collect()}
    assert [np.mean([i in got for i in range(k, 90, 3)]) for k in (0, 1)] == [1, 1] and np.mean([i in got for i in range(2, 90, 3)]) <= 0.1


def test_toxicity_shards(spark):
    """Many shards: the same weights for any order of the input, and as good as one."""
    docs = toxic_docs(random.Random(19), 500)
    known = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in docs[:400]] + [(9999, 1)], "doc_id bigint, label int")
    own = lambda rows, n: spark.createDataFrame(rows, "doc_id bigint, text string").repartition(n)
    a, b = toxicity.train(own(docs, 3), known, (20, 1 << 30)), toxicity.train(own(docs[::-1], 5), known, (20, 1 << 30))
    assert a.threshold == b.threshold and (a.flat() == b.flat()).all()
    best = toxicity.doc_scores(a, K.words(pa.array([t for _, t in docs[400:]])))[0] >= a.threshold
    assert best[::4].mean() >= 0.9 and np.delete(best, np.s_[::4]).mean() <= 0.05


def test_toxicity_long_documents_in_blocks(monkeypatch):
    w = K.words(pa.array([t for _, t in toxic_docs(random.Random(23), 8)]))
    vocab, flats = toxicity.Vocabulary.of(w), []
    for batch in (2048, 5):
        monkeypatch.setattr(toxicity, "BATCH", batch)
        net, moved = toxicity.Net.fresh(), np.zeros(toxicity.WORDS + toxicity.TRIGRAMS, "f4")
        rare = np.zeros(toxicity.WORDS, bool), np.zeros(toxicity.TRIGRAMS, bool)
        toxicity.learn(net, w, vocab, np.arange(8), np.arange(8) % 4 == 0, np.full(8, 0.125), 0.3, rare, moved, np.random.default_rng(1))
        flats.append(net.flat())
    assert np.abs(flats[0] - toxicity.Net.fresh().flat()).max() > 0.01 and np.abs(flats[0] - flats[1]).max() < 1e-3


def test_quality_query_against_plain(spark, monkeypatch):
    r = random.Random(14)
    junk = lambda t: " ".join(x.upper() + "!!" for x in t.split())
    docs = [(i, prose(r, r.randrange(10, 300)) if i % 3 else junk(prose(r, r.randrange(10, 300)))) for i in range(150)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in docs] + [(None, 0), (999, 1), (2, None)], "doc_id bigint, quality int")
    models, train = [], quality.train
    monkeypatch.setattr(quality, "train", lambda *a: models.append(train(*a)) or models[-1])
    docs += [(None, docs[1][1]), docs[4], docs[4], (500, prose(r, 5000)), (501, None), (502, "..."), (503, "word")]
    got = sorted(((x.doc_id, x.n_passages, x.top_passage, x.score) for x in quality.good_documents(frame(spark, docs), labels).collect()), key=str)
    m, want = models[0], []
    for d, t in docs:
        x = quality.describe(K.words(pa.array([t], pa.string())))[1]
        if len(x):
            h = [np.tanh((v - m.mean) / m.scale @ m.p["W"] + m.p["b"]) for v in x]
            s = np.array([float(m.p["w"] @ (np.tanh(v @ m.p["V"]) / (1 + np.exp(-(v @ m.p["U"]))))) for v in h])
            a = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
            score = 1 / (1 + np.exp(-(sum(w * v for w, v in zip(a, h)) @ m.p["c"] + m.p["d"][0])))
            if score >= m.threshold:
                want.append((d, len(x), int(np.argmax(np.round(a, 9))), score))
    want.sort(key=str)
    assert [x[:3] for x in got] == [x[:3] for x in want] and all(abs(a[3] - b[3]) < 1e-4 for a, b in zip(got, want))
    assert {None, 4} <= {x[0] for x in got} and not {501, 502} & {x[0] for x in got}


def test_quality_model_against_plain():
    r = np.random.default_rng(1)
    m = quality.Model.fresh(r.standard_normal((50, quality.WIDTH)))
    x, row = r.standard_normal((7, quality.WIDTH)), np.array([0, 0, 0, 2, 2, 2, 2])
    logit, back = quality.forward(m, x, row, 3)
    for bag in (0, 2):
        h = np.tanh((x[row == bag] - m.mean) / m.scale @ m.p["W"] + m.p["b"])
        s = [float(m.p["w"] @ (np.tanh(v @ m.p["V"]) / (1 + np.exp(-(v @ m.p["U"]))))) for v in h]
        a = np.exp(s) / np.exp(s).sum()
        assert abs((a[:, None] * h).sum(axis=0) @ m.p["c"] + m.p["d"][0] - logit[bag]) < 1e-9
    grads = quality.backward(m, back, row, logit, np.array([1.0, 0, 1.0]))
    for name, value in m.p.items():
        at = tuple(0 for _ in value.shape)
        old = value[at]
        value[at] = old + 1e-5
        up = quality.forward(m, x, row, 3)[0][[0, 2]].sum()
        value[at] = old - 1e-5
        down = quality.forward(m, x, row, 3)[0][[0, 2]].sum()
        value[at] = old
        assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-5, name


def test_passages():
    w = K.words(pa.array([prose(random.Random(1), 150), None, "a b", prose(random.Random(2), 64)]))
    row, first, last = quality.passages(w)
    assert list(zip(row, first - w.ptr[row], last - w.ptr[row])) == [(0, 0, 64), (0, 64, 150), (2, 0, 2), (3, 0, 64)]
    assert len(quality.describe(w)[1]) == 4


def test_quality_held_out(spark):
    r = random.Random(5)
    junk = lambda t: " ".join(x.upper() + "!!" for x in t.split())
    rows = []
    for i in range(500):
        t = prose(r, r.randrange(10, 300))
        rows.append((i, int(i % 4 > 0), t if i % 4 else junk(t)))
    docs = frame(spark, [(i, t) for i, _, t in rows] + [(900, None), (901, "...")])
    labels = spark.createDataFrame([(i, y) for i, y, _ in rows[:300]], "doc_id bigint, quality int")
    got = {x.doc_id for x in quality.good_documents(docs, labels).collect()}
    assert np.mean([i in got for i, y, _ in rows[300:] if y]) >= 0.98
    assert np.mean([i in got for i, y, _ in rows[300:] if not y]) <= 0.05
    assert not {900, 901} & got


# 8: packing


def test_bounds_are_optimal():
    r = random.Random(1)
    for _ in range(20):
        lengths = [r.randrange(0, 40) for _ in range(r.randrange(1, 14))]
        u, n = np.unique(lengths, return_counts=True)
        for buckets in (1, 2, 3, 4):
            b = packing.bounds(u, n, buckets)
            assert len(b) <= buckets and brute.padding(lengths, b) == brute.least_padding(lengths, buckets)


def test_packing(spark):
    docs = [(i, prose(random.Random(i), i % 7)) for i in range(50)] + [(None, "a b c"), (60, None), (61, prose(random.Random(1), 300))]
    got = packing.pack(frame(spark, docs), buckets=3, budget=20).collect()
    assert len(got) == len(docs)
    batches = {}
    for r in got:
        assert r.padding == r.bucket_len - r.n_tokens >= 0
        batches.setdefault((r.bucket_len, r.batch), []).append(r)
    assert all(len(b) == 1 or sum(r.bucket_len for r in b) <= 20 for b in batches.values())


# 10: repetition


def test_repetition_against_plain(spark):
    r = random.Random(2)
    docs = [(i, prose(r, r.randrange(0, 60), 12)) for i in range(60)] + [(70, "a b c d e f " * 30), (71, None), (72, "a a a a a a a a")]
    w, c, m, _ = repetition.measure(pa.array([t for _, t in docs]))
    assert list(zip(w.tolist(), c.tolist(), m.tolist())) == [brute.repeats(t) for _, t in docs]
    kept = {x.doc_id for x in repetition.keep_unrepetitive(frame(spark, docs)).collect()}
    assert kept == {d for d, _ in brute.unrepetitive(docs)}
