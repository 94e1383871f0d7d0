"""PII: identifiers found by bootstrapped lexical patterns.

Candidates are all stretches of a text that look like identifiers: with digits in
groups, an at sign, mixed letters and digits, or a key and its value, of any length.
A value runs to its closing quote or white space, without the punctuation that ends
it, or to the next key and its value. A candidate
is an instance; what it looks like and what stands around it are patterns:

* its shape (runs of letters, digits and of both, with the lengths of the digits),
* its key (for key = value) or the word before it, with its coarse shape,
* the word behind it, with its coarse shape.

Seeds are instances that a strict rule knows: addresses of mail with a known form,
card numbers with a valid check digit, dotted quads, phone numbers with a country
code, values of keys such as ``password``, and access keys of a known form. Seeds score 1 for their kind and
stay so. In each of ``ROUNDS`` rounds a pattern's confidence is the mean score of
its different instances, with ``PRIOR`` more that score 0, and an instance's score
is one minus the product of (1 - confidence) over its best shape and its best
context, if the pattern has at least ``SUPPORT`` different instances. What reaches
``THRESHOLD`` is reported, so confident patterns find identifiers that no rule
knows, such as numbers with a mistyped check digit.

The graph of patterns and instances is as large as the set of different
candidates. It is grouped with distributed aggregation; nothing of it reaches the
driver, and each round is written to the shared folder.

Result: doc_id, kind, start and end (characters, end exclusive), score, seed.

Defined cases: a null or empty text has no candidates; null ids stay null in the
report; repeated rows are reported each, but count once for a pattern, as equal
candidates do; of equally scored kinds the first by name is reported; an empty
table gives an empty result. Only the id and the text are read, so further columns
may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .textkit import chunks

ROUNDS = 3
PRIOR = 1.0
SUPPORT = 3
THRESHOLD = 0.6
KEYS = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "auth", "key")
#: What may end a value; inside one it belongs to it.
_END = r"[.,;:?)\]}><&|]"
_RUN = rf"""(?:[^\s"'.,;:?)\]}}><&|]++|(?!{_END}*+(?<=[,;&|?])[A-Za-z_]\w*+\ ?[=:])(?!</?[A-Za-z]){_END}++(?![\s"']|\Z))++"""
#: A value that is an address, a number or a phone number itself is a candidate without its key.
_PLAIN = r"(?=[A-Za-z_+/-]*+\d)(?=[A-Za-z0-9_+/-]{8})|(?!//)(?![\w.+%-]{1,64}@[\w-]{1,63}\.[\w-])(?!\d{1,3}(?:\.\d{1,3}){3}(?![.]?\w))(?!\+\d{1,3}[.(])(?!\d+\.[\d.]*+(?!\w))"
LEAST_VALUE = 8
CANDIDATE = re.compile(
    r"""(?P<mail>[\w.+%-]{1,64}@[\w-]{1,63}(?:\.[\w-]{1,63}){1,8})
    |(?P<pair>(?<!\w)[A-Za-z_]{2,24}\ ?[=:]\ ?(?:"(?=PLAIN)(?P<double>[^\s"]++)"|'(?=PLAIN)(?P<single>[^\s']++)'|["']?(?:PLAIN)(?P<bare>RUN)["']?))
    |(?<![\w.])(?P<quad>\d{1,3}(?:\.\d{1,3}){3})(?![.]?\w)
    |(?P<phone>\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){1,4}(?!\w|\.\d))
    |(?<!\w)(?P<code>(?:(?=[A-Za-z]*+\d)[A-Za-z0-9]{9,}+))(?!\w)
    |(?<![\w.])(?P<groups>\(?\d{2,4}\)?(?:[ -]\d{2,4}){1,6}(?!\w))
    |(?<!\w)(?P<number>\d[\d.]*\d)(?!\w)""".replace("PLAIN", _PLAIN).replace("RUN", _RUN),
    re.X,
)
DIGIT = re.compile(r"\d|@")
BEFORE, AFTER = re.compile(r"\s*(\S*)"), re.compile(r"\s*(\S*)")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def shape(value: str, lengths: bool = True) -> str:
    """a: letters, x: letters and digits, 9: digits, with their number if lengths is on; other characters as they are."""

    def run(m: re.Match) -> str:
        s = m[0]
        if s.isdigit():
            return f"9{len(s)}" if lengths else "9"
        return "a" if s.isalpha() else "x" + (str(len(s).bit_length()) if lengths else "")

    return re.sub(r"[^\W_]+", run, value)


def seed_of(kind: str, value: str) -> str | None:
    """The kind of identifier that a strict rule knows the candidate to be."""
    if kind == "mail":
        return "email" if re.fullmatch(r"[A-Za-z][\w.+-]*@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", value, re.A) else None
    if kind == "pair":
        key, x = re.split(r"\s?[=:]\s?", value, maxsplit=1)
        x = x.strip("\"'")
        return "secret" if key.lower() in KEYS and len(x) >= 16 and re.search(r"[A-Za-z]", x) else None
    if kind == "quad":
        return "ip" if all(int(p) < 256 and (p == "0" or p[0] != "0") for p in value.split(".")) else None
    if kind == "code" and re.fullmatch(r"AKIA[0-9A-Z]{16}", value):
        return "secret"
    digits = re.sub(r"\D", "", value)
    if kind == "phone":
        return "phone" if 10 <= len(digits) <= 15 else None
    if kind in ("code", "number", "groups") and len(digits) in (15, 16) and digits == re.sub(r"[ -]", "", value):
        return "card" if digits[0] in "3456" and luhn(digits) else None
    return None


def patterns_of(kind: str, value: str, before: str, after: str) -> list[tuple[str, bool]]:
    """The patterns of a candidate, and whether each is a shape."""
    coarse = kind if kind in ("mail", "pair", "quad", "phone") else shape(value, False)
    if kind == "pair":
        key, x = re.split(r"\s?[=:]\s?", value, maxsplit=1)
        own = f"shape {shape(x.strip(chr(34) + chr(39)))} = "
        before = key
    elif kind in ("mail", "quad"):
        own = "shape " + re.sub(r"9\d*", "9", shape(value)) if kind == "quad" else "shape mail " + str(value.count("."))
    else:
        own = "shape " + shape(value)
    return [(own, True), (f"before {before.lower()} {coarse}", False), (f"after {after.lower()} {coarse}", False)]


def candidates(text: str) -> Iterator[tuple[int, int, str, str, str, str]]:
    """Start, end, form, value, the word before and the word behind, of every candidate."""
    at = 0
    while m := CANDIDATE.search(text, at):
        s, e = m.span()
        at = e
        if m.lastgroup == "pair":
            form = next(x for x in ("double", "single", "bare") if m[x] is not None)
            if len(m[form]) < LEAST_VALUE or not re.search(r"\d", m[form]):
                at = m.start(form)  # the value may be or hold a candidate
                continue
        before = BEFORE.match(text[:s][::-1]) if s < 64 else BEFORE.match(text[s - 64 : s][::-1])
        if before.end() == 64:  # the word before, or the space behind it, is longer
            before = BEFORE.match(text[:s][::-1])
        yield s, e, m.lastgroup, m[0], before[1][::-1], AFTER.match(text, e)[1]


def key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def found(docs: DataFrame, id: str, text: str) -> DataFrame:
    """A row for each candidate: doc_id, start, end, instance, seed (its kind or null), own (shape) and near (contexts) as hashes."""
    names = ["doc_id", "start", "end", "instance", "seed", "own", "near"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            rows: list[tuple] = []
            which: list[int] = []
            for k, t in enumerate(b.column("text").to_pylist()):
                if not t or not DIGIT.search(t):
                    continue
                for s, e, kind, value, before, after in candidates(t):
                    (own, _), *near = patterns_of(kind, value, before, after)
                    which.append(k)
                    rows.append((s, e, key(f"{kind} {value.lower()}"), seed_of(kind, value), key(own), [key(p) for p, _ in near]))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(which)), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=names)

    slim = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, start bigint, end bigint, instance bigint, seed string, own bigint, near array<bigint>")


def scored(edges: DataFrame, rounds: int = ROUNDS, prior: float = PRIOR, support: int = SUPPORT) -> DataFrame:
    """instance, kind, score from edges (instance, seed, pattern, is_shape)."""
    spark = edges.sparkSession
    count = edges.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= support)
    # a context that only few instances share says nothing, and most contexts are such
    used = stored(edges.join(count, "pattern").select("instance", "seed", "pattern", "is_shape", "n"), "pattern-graph")
    seeds = used.filter("seed is not null").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    score = seeds
    for _ in range(rounds):
        rows = used.select("instance", "pattern", "is_shape", "n").join(score, "instance")
        trust = rows.groupBy("pattern", "is_shape", "kind").agg((F.sum("score") / (F.first("n") + F.lit(prior))).alias("trust"))
        back = used.filter("seed is null").select("instance", "pattern").join(trust, "pattern")
        best = back.groupBy("instance", "kind").agg(F.max(F.when(F.col("is_shape"), F.col("trust")).otherwise(0.0)).alias("own"), F.max(F.when(~F.col("is_shape"), F.col("trust")).otherwise(0.0)).alias("near"))
        new = best.select("instance", "kind", (1 - (1 - F.col("own")) * (1 - F.col("near"))).alias("score"))
        score = stored(seeds.unionAll(new), "scores")
    return spark.createDataFrame([], score.schema) if not rounds else score


def identifiers(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, **graph) -> DataFrame:
    """doc_id, kind, start, end, score and seed of every identifier."""
    seen = stored(found(docs, id, text), "candidates")
    both = F.concat(F.array(F.struct(F.col("own").alias("pattern"), F.lit(True).alias("is_shape"))), F.transform("near", lambda p: F.struct(p.alias("pattern"), F.lit(False).alias("is_shape"))))
    # equal candidates are one instance; each of its patterns is one edge
    edges = seen.select("instance", "seed", F.explode(both).alias("p")).select("instance", "seed", "p.pattern", "p.is_shape").distinct()
    score = scored(edges, **graph).filter(F.col("score") >= threshold)
    best = score.groupBy("instance").agg(F.min_by(F.struct("kind", "score"), F.struct(-F.col("score"), F.col("kind"))).alias("b"))
    seeded = F.col("seed").isNotNull()
    # a seed is known without the graph: it may have no pattern with support
    out = seen.join(best, "instance", "left").filter(seeded | F.col("b").isNotNull())
    return out.select("doc_id", F.coalesce("seed", "b.kind").alias("kind"), "start", "end", F.round(F.when(seeded, 1.0).otherwise(F.col("b.score")), 6).alias("score"), seeded.alias("seed"))
