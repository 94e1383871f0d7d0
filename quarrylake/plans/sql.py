"""The catalogue's common table expressions in DuckDB's SQL, named so that queries ask for what they need."""

from __future__ import annotations

import re

from .lake import FAMILIES, LAKE

VECTOR_WORDS = "(select count(*) from embeddings)"


def hash32(x: str, part: int = 0) -> str:
    return f"('0x' || substr(md5({x}), {8 * part + 1}, 8))::bigint"


def trimmed(v: str) -> str:
    return rf"regexp_replace({v}, '^\s+|\s+$', '', 'g')"


def normalised(v: str) -> str:
    return rf"lower(regexp_replace({trimmed(v)}, '^\p{{P}}+|\p{{P}}+$', '', 'g'))"


def tokens(v: str) -> str:
    return rf"list_filter(list_transform(string_split({normalised(v)}, ' '), lambda w: {normalised('w')}), lambda w: length(w) > 0)"


def entity_words(v: str) -> str:
    return rf"list_filter(list_transform(string_split(lower(replace(regexp_replace({v}, '\([^)]*\)', '', 'g'), '_', ' ')), ' '), lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')), lambda w: length(w) >= 3)"


def get_words(v: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({v}), '[^a-z]+', ' ', 'g'), ' '), lambda w: length(w) >= 3)"


def _slices() -> str:
    out = []
    for name, (base, cs) in FAMILIES.items():
        row = ", ".join(cs)
        rows = f"(select distinct {row} from {base})"
        dealt = f"(select {row}, {hash32(f'concat_ws({chr(39)}|{chr(39)}, {row})')} % least(5, greatest((select count(*) // 100 from {rows}), 1)) j from {rows})"
        out += [f"select '{name}____' || j t, '{c}' c, {c} v from {dealt}" for c in cs]
    return " union all ".join(out)


def jaccards(d: str) -> str:
    return f"""select a.t qt, a.c qc, b.t ct, b.c cc, any_value(n1.n) nq, any_value(n2.n) nc, round(count(*) / (any_value(n1.n) + any_value(n2.n) - count(*))::double, 6) score from {d} a join {d} b on a.v = b.v and a.t <> b.t
    join (select t, c, count(*) n from {d} group by all) n1 on n1.t = a.t and n1.c = a.c join (select t, c, count(*) n from {d} group by all) n2 on n2.t = b.t and n2.c = b.c group by a.t, a.c, b.t, b.c"""


def greedy(name: str, pairs: str, order: str = "score desc", score: str = "score", by: tuple[str, str] = ("qt", "ct"), q: str = "qc", c: str = "cc") -> dict[str, str]:
    """The alignment of pairs as two expressions: name_r ranks them, name_w walks along the ranks; name has by, k, q, c, score."""
    g = ", ".join(by)
    ok = f"not list_contains(w.uq, n.{q}) and not list_contains(w.uc, n.{c})"
    return {
        f"{name}_r": f"select *, row_number() over (partition by {g} order by {order}, {q}, {c}) r from {pairs}",
        f"{name}_w": f"""select {g}, r, {q}, {c}, {score}, [{q}] uq, [{c}] uc, true ok from {name}_r where r = 1
        union all select n.{by[0]}, n.{by[1]}, n.r, n.{q}, n.{c}, n.{score}, case when {ok} then list_append(w.uq, n.{q}) else w.uq end, case when {ok} then list_append(w.uc, n.{c}) else w.uc end, {ok}
        from {name}_w w join {name}_r n on n.{by[0]} = w.{by[0]} and n.{by[1]} = w.{by[1]} and n.r = w.r + 1""",
        name: f"select {g}, row_number() over (partition by {g} order by r) k, {q}, {c}, {score} from {name}_w where ok",
    }


def c_scores(name: str, aligned: str, score: str = "score") -> dict[str, str]:
    return {
        f"{name}_p": f"select qt, ct, k c, exp(sum(ln({score})) over (partition by qt, ct order by k)) p from {aligned} where {score} > 0",
        name: f"select qt, ct, c, round(p, 6) score, round(coalesce(lag(p) over (partition by qt, ct order by c), 1.0) - p, 6) difference from {name}_p",
    }


def equi_depth(name: str, scores: str, bins: int) -> dict[str, str]:
    """Bins by measure: a walk along the different scores."""
    return {
        f"{name}_h": f"select *, row_number() over (partition by measure order by score) r, sum(n) over (partition by measure)::bigint total from (select measure, round(least(score, 1.0), 4) score, count(*) n from {scores} group by all)",
        f"{name}_w": f"""select measure, r, total, 0.0::double lo, score hi, n, 0::bigint acc, 0::bigint bin from {name}_h where r = 1
        union all select h.measure, h.r, h.total, case when w.n >= greatest(1, h.total // {bins}) then w.hi else w.lo end, h.score, case when w.n >= greatest(1, h.total // {bins}) then h.n else w.n + h.n end,
        case when w.n >= greatest(1, h.total // {bins}) then w.acc + w.n else w.acc end, case when w.n >= greatest(1, h.total // {bins}) then w.bin + 1 else w.bin end
        from {name}_w w join {name}_h h on h.measure = w.measure and h.r = w.r + 1""",
        name: f"""select measure, bin, round(lo, 6) lower, round(case when last then 1.0 else hi end, 6) upper, n, acc + n acc, round(case when last then 1.0 else acc / total::double end, 6) pct
        from (select *, bin = max(bin) over (partition by measure) last from (select *, row_number() over (partition by measure, bin order by r desc) z from {name}_w) where z = 1)""",
    }


def percentile(s: str, cdf: str = "cdf") -> str:
    return f"case when {s} > 0 then coalesce((select arg_min(b.pct, b.bin) from {cdf} b where b.measure = m.measure and b.upper >= least({s}, 1.0)), 0.0) else 0.0 end"


CTE: dict[str, str] = {
    "lake": " union all ".join(f"select '{t}' t, '{c}' c, {c}::varchar v from {t}" for t, cs in LAKE.items() for c in cs),
    "dom": f"select distinct t, c, lower({trimmed('v')}) v from lake where strlen({trimmed('v')}) > 2",
    "slices": _slices(),
    "lwords": f"select distinct t, c, unnest({get_words('v')}) v from dom",
    "sdom": f"select distinct t, c, lower({trimmed('v')}) v from slices where strlen({trimmed('v')}) > 2",
    "sfreq": f"select t, c, lower({trimmed('v')}) v, count(*) freq from slices where strlen({trimmed('v')}) > 2 group by all",
    "jac": jaccards("sdom"),
    "types": "select distinct lower(p_name) entity, lower(p_type) category from part union select lower(n_name), lower(r_name) from nation join region on n_regionkey = r_regionkey",
    "kinds": "select distinct category sub, 'kind of ' || substr(category, 1, 1) super from types",
    "taxonomy": "select * from kinds union select super, 'thing' from kinds",
    "idx": f"select entity, len({entity_words('entity')})::bigint total, unnest({entity_words('entity')}) word from (select distinct entity from types)",
    "vwords": f"select v, len({get_words('v')})::bigint n, unnest({get_words('v')}) word from (select distinct v from sdom)",
    "matches": "select v, entity from vwords join (select distinct * from idx) using (word) group by v, entity, n, total having count(*) = n and total = n",
    "annotated": "select t, c, count(distinct case when entity is not null then v end) n_annotated, count(distinct case when entity is null then v end) n_unannotated, count(distinct entity) n_entities from sdom left join matches using (v) group by all",
    "classes": "select t, c, category v, count(*) freq from (select distinct t, c, entity from sdom join matches using (v)) join types using (entity) group by all",
    "sem": jaccards("classes"),
    "vtok": f"select v, unnest(w) word from (select v, {tokens('v')} w, len(string_split({normalised('v')}, ' ')) n from (select distinct v from sfreq)) where n <= 5",
    "vcomp": f"select v, i - 1 i, sum(embedding[i]::double) x from vtok join embeddings on vec_id = {hash32('word')} % {VECTOR_WORDS}, unnest(range(1, 65)) u(i) group by all",
    "vmean": "select t, c, i, sum(freq * x) / sum(freq)::double mean from sfreq join vcomp using (v) group by all",
    "vdoms": "select t, c, list(mean order by i) mean from vmean group by all",
    "nl": "select a.t qt, a.c qc, b.t ct, b.c cc, round(list_cosine_similarity(a.mean, b.mean), 6) score from vdoms a join vdoms b on a.t <> b.t",
    "meas": "select * from (select qt, qc, ct, cc, 'set' measure, least(score, 1.0) score from jac union all select qt, qc, ct, cc, 'sem', least(score, 1.0) from sem union all select qt, qc, ct, cc, 'nl', least(score, 1.0) from nl) where score <> 0",
    **equi_depth("cdf", "meas", 20),
    "pcts": f"select *, {percentile('round(score, 4)')} pct, {percentile('round(round(score, 4) + 0.1, 4)')} plus, {percentile('round(greatest(round(score, 4) - 0.1, 0.0), 4)')} minus from meas m",
    "ens": """select qt, qc, ct, cc, measure, score raw, pct, minus, plus from pcts qualify row_number() over (partition by qt, qc, ct, cc
        order by minus desc, plus desc, case measure when 'nl' then 2 when 'set' then 1 else 0 end desc) = 1""",
    "ens_pos": "select * from ens where pct > 0",
    **greedy("al", "ens_pos", "minus desc, plus desc, raw desc", "pct"),
    **c_scores("cs", "al", "pct"),
    "ccs": "select c::varchar measure, qt, ct, c, score from cs",
    **equi_depth("ccdf", "ccs", 20),
    "cpct": f"select *, {percentile('round(score, 4)', 'ccdf')} pct, {percentile('round(round(score, 4) + 0.1, 4)', 'ccdf')} plus, {percentile('round(greatest(round(score, 4) - 0.1, 0.0), 4)', 'ccdf')} minus from ccs m",
    "bestc": "select * from cpct qualify row_number() over (partition by qt, ct order by plus desc, c desc) = 1",
    "topn": "select qt, ct, c, score, minus, pct, plus, row_number() over (partition by qt order by minus desc, plus desc, ct) rank from bestc where pct > 0 qualify rank <= 10",
    **greedy("jal", "jac"),
    **c_scores("jcs", "jal"),
    "keys": "select distinct t, c, string_split(t, '____')[1] base from sdom",
    "truth": "select a.t qt, a.c qc, b.t ct, b.c cc from keys a join keys b on a.base = b.base and a.t <> b.t and a.c = b.c",
    "truth_t": "select distinct qt, ct from truth",
    "emb": "select label, i - 1 i, embedding[i]::double x from embeddings, unnest(range(1, 65)) u(i)",
    "embm": "select label, i, sum(x) total, avg(x) mean, sum(x * x) / count(*) - avg(x) * avg(x) var, count(*) n from emb group by all",
    "embg": "select label, list(mean order by i) mean, list(var order by i) var, max(n)::double n from embm group by all",
    "idf": "select v, sum(freq)::bigint df, 1 + ln(sum(sum(freq)) over () / sum(freq)) idf from sfreq group by v",
    "tfidf": "select t, c, v, freq / sum(freq) over (partition by t, c)::double * idf w from sfreq join idf using (v)",
    "unit": "select t, c, v, w / sqrt(sum(w * w) over (partition by t, c)) w from tfidf",
    "cosv": "select a.t qt, a.c qc, b.t ct, b.c cc, round(sum(a.w * b.w), 6) score from unit a join unit b on a.v = b.v and a.t <> b.t group by all",
    "lens": "select t, c, avg(strlen(v)) len from slices group by all",
    "lend": "select a.t qt, a.c qc, b.t ct, b.c cc, round(abs(a.len - b.len), 6) distance from lens a join lens b on a.t <> b.t",
    **greedy("szal", "lend", "distance", "distance"),
    **greedy("cosal", "cosv"),
}


def query(final: str, more: dict[str, str] | None = None) -> str:
    """final with the expressions that it needs, in order."""
    every = CTE | (more or {})
    out: list[str] = []
    seen: set[str] = set()

    def need(text: str) -> None:
        for name in every:
            if name not in seen and re.search(rf"\b(?:from|join)\s+{name}\b", text):
                seen.add(name)
                need(every[name])
                out.append(name)

    need(final)
    if not out:
        return final
    recursive = "recursive " if any(n.endswith("_w") for n in out) else ""
    return f"with {recursive}" + ",\n".join(f"{n} as {'' if n.endswith('_w') else 'materialized '}({every[n]})" for n in out) + "\n" + final
