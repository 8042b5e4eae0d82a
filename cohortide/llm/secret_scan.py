"""Secret scan: regexes by way of a trigram inverted index.

Each rule's regex gives a Boolean query over trigrams that every match must contain.  Texts are indexed by the trigrams that
queries ask for, postings are intersected, and only what is left is searched with the regex; rules
without a mandatory trigram search every text.  All of it is built-in functions.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _parser as regex

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortide.llm.scratch import clear, keep

#: Different texts whose postings stand together.
BLOCK = 4096
#: Strings that a part of a regex may be spelled out to, and alternatives of a query; beyond, a query asks for less.
SPELLED, CLAUSES = 32, 64


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` code points; the pattern is one for Java and Python alike."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


# Kinds that results must carry, in this order, then tokens in well-known formats.
BASE = (
    Rule(
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
        True,
    ),
    Rule("access", "AKIA[A-Z0-9]{12,}", base=True),
    Rule("hex", "[0-9a-f]{32,}", base=True),
)
OWN = (
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", "gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("maps", "AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", "[rs]k_live_[0-9a-zA-Z]{24,}"),
    Rule("signed", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("login", r"[a-z]{2,12}://[A-Za-z0-9._-]+:[^\x00-\x20/@]+@"),
)
RULES = BASE + OWN

Query = list[frozenset[str]]
_ANY: Query = [frozenset()]


def _both(a: Query, b: Query) -> Query:
    """All clauses of two queries together; past the limit the first alone, which asks for less."""
    out = {x | y for x in a for y in b}
    return sorted(out, key=sorted) if len(out) <= CLAUSES else a


def _either(parts: list[Query]) -> Query:
    out = {c for p in parts for c in p}
    out = {c for c in out if not any(d < c for d in out)}  # what a shorter clause allows anyway
    return sorted(out, key=sorted) if len(out) <= CLAUSES else _ANY


def _holds(strings: set[str]) -> Query:
    return _either([[frozenset(s[i : i + 3] for i in range(len(s) - 2))] for s in strings])


def _letters(items: list) -> set[str] | None:
    """What one code point may be, lowered; None if that is much or not ASCII."""
    out: set[str] = set()
    for op, value in items:
        low, high = value if op is regex.RANGE else (value, value)
        if op not in (regex.LITERAL, regex.RANGE) or high > 127 or high - low >= SPELLED:
            return None
        out |= {chr(c).lower() for c in range(low, high + 1)}
    return out


def _read(parsed) -> tuple[set[str] | None, Query]:
    """Of a part of a regex: all it can match, lowered, or None; and the query when it is None."""
    now, query = {""}, _ANY
    whole = True
    for op, value in parsed:
        spelled, asked = None, _ANY
        if op in (regex.LITERAL, regex.IN):
            spelled = _letters([(op, value)] if op is regex.LITERAL else value)
        elif op is regex.SUBPATTERN:
            spelled, asked = _read(value[-1])
        elif op is regex.BRANCH:
            parts = [_read(p) for p in value[1]]
            if all(s is not None for s, _ in parts):
                spelled = set().union(*(s for s, _ in parts))
            else:
                asked = _either([_holds(s) if s is not None else q for s, q in parts])
        elif op in (regex.MAX_REPEAT, regex.MIN_REPEAT):
            least, most, inner = value
            inner, asked = _read(inner)
            if inner is not None and (least, most) == (0, 1):
                spelled = inner | {""}
            elif inner is not None and least == most and len(inner) ** least <= SPELLED:
                spelled = {""}
                for _ in range(least):
                    spelled = {a + b for a in spelled for b in inner}
            elif not least:
                asked = _ANY
            elif inner is not None and len(now) * len(inner) <= SPELLED:
                # the first repetition ends what came before, the last begins what follows
                whole, query, now = False, _both(query, _holds({a + b for a in now for b in inner})), inner
                continue
        if spelled is not None and len(now) * len(spelled) <= SPELLED:
            now = {a + b for a in now for b in spelled}
            continue
        # what was spelled out so far ends here
        whole = False
        query = _both(query, _holds(now))
        now = {""}
        if spelled is not None and len(spelled) <= SPELLED:
            now = spelled
        else:
            query = _both(query, asked)
    return (now, _ANY) if whole else (None, _both(query, _holds(now)))


def trigram_query(pattern: str) -> Query:
    """Sets of trigrams: a lowered text with a match holds all of one set.  An empty set asks for nothing."""
    spelled, query = _read(regex.parse(pattern))
    return _holds(spelled) if spelled is not None else query


def _table(spark, rows: list[tuple], names: list[str]) -> DataFrame:
    """A few rows as a table without files."""
    values = [F.struct(*[F.lit(v).alias(c) for v, c in zip(r, names, strict=True)]) for r in rows]
    return spark.range(1, numPartitions=1).select(F.explode(F.array(*values)).alias("r")).select("r.*")


def trigram_index(texts: DataFrame, trigrams: list[str], blocks: int) -> DataFrame:
    """Postings (block, trigram, keys) of texts (key, text): sorted keys of the texts that hold the trigram.

    Equal texts have one key, so a text with a third of all rows is posted once.
    """
    wanted = F.array(*map(F.lit, trigrams))
    held = F.transform(F.array(F.lower("text")), lambda low: F.filter(wanted, lambda t: F.contains(low, t)))[0]
    rows = texts.select("key", F.explode(held).alias("trigram"))
    rows = rows.groupBy(F.pmod("key", F.lit(blocks)).alias("block"), "trigram")
    return rows.agg(F.sort_array(F.collect_set("key")).alias("keys"))


def candidates(index: DataFrame, queries: list[Query]) -> DataFrame:
    """(key, rules): which rules' queries a text satisfies, by intersecting postings block by block."""
    rows = [(r, c, t, len(clause)) for r, query in enumerate(queries) for c, clause in enumerate(query) for t in sorted(clause)]
    asked = _table(index.sparkSession, rows, ["rule", "clause", "trigram", "need"])
    lists = index.join(F.broadcast(asked), "trigram").groupBy("block", "rule", "clause", "need")
    lists = lists.agg(F.collect_list("keys").alias("lists")).filter(F.size("lists") == F.col("need"))
    met = F.aggregate(F.slice("lists", F.lit(2), F.size("lists")), F.col("lists")[0], F.array_intersect)
    return lists.select("rule", F.explode(met).alias("key")).groupBy("key").agg(F.collect_set("rule").alias("rules"))


def _running(lengths: Column, start: Column) -> Column:
    first = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))

    def add(done: Column, n: Column) -> Column:
        return F.struct((done["at"] + n).alias("at"), F.concat(done["out"], F.array(done["at"] + n)).alias("out"))

    return F.aggregate(lengths, first, add, lambda done: done["out"])


def running_sums(lengths: Column, part: int = 256) -> Column:
    """Sums up to each element; in parts, so that long arrays aren't copied for each element."""
    zero = F.lit(0).cast("bigint")
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / part).cast("int")), lambda c: F.slice(lengths, c * part + 1, F.lit(part)))
    parts = F.when(F.size(lengths) > 0, parts).otherwise(F.array().cast("array<array<bigint>>"))
    sums = F.transform(parts, lambda p: F.aggregate(p, zero, lambda a, n: a + n))
    starts = F.transform(F.arrays_zip(_running(sums, zero).alias("end"), sums.alias("own")), lambda s: s["end"] - s["own"])
    return F.flatten(F.zip_with(parts, starts, _running))


def _spans(text: Column, rule: Column) -> Column:
    """Leftmost matches of a rule: what stands between them gives their places."""
    found = F.regexp_extract_all(text, rule["pattern"], F.lit(0))
    judged = F.regexp_extract_all(text, rule["pattern"], rule["group"])
    gaps = F.split(text, rule["pattern"], -1)
    sizes = F.transform(found, lambda m: F.length(m).cast("bigint"))
    steps = F.zip_with(sizes, F.slice(gaps, F.lit(1), F.size(found)), lambda n, g: n + F.length(g))
    spans = F.zip_with(
        F.arrays_zip(running_sums(steps).alias("end"), sizes.alias("size")),
        judged,
        lambda s, g: F.struct(
            (s["end"] - s["size"]).alias("start"),
            rule["rank"].alias("rank"),
            s["end"].alias("end"),
            rule["kind"].alias("kind"),
            rule["base"].alias("base"),
            F.length(g).alias("size"),
        ),
    )
    return F.filter(spans, lambda s: s["size"] >= rule["least"])


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", block: int = BLOCK) -> DataFrame:
    """Add ``secrets`` to every row: (start, rank, end, kind, base, size) of the spans that rules match, sorted.

    ``start`` and ``end`` (exclusive) count code points of the whole text, ``rank`` is the rule's place among ``rules``, and
    ``size`` the length of its judged group.  Matches of one rule are leftmost and don't overlap.  Null and empty texts have none;
    copies and ties need no rule, as rows are searched one by one; an empty table stays empty.  An input column ``secrets`` is replaced,
    all others stay whatever their names.
    """
    spark, shelf = docs.sparkSession, []
    queries = [trigram_query(r.pattern) for r in rules]
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct(*[c for c in docs.columns if c != "secrets"]).alias("row"), whole.alias("text"), F.xxhash64(whole).alias("key"))
    asked = [q if frozenset() not in q else [] for q in queries]
    trigrams = sorted({t for q in asked for clause in q for t in clause})
    if trigrams:
        texts = docs.select(F.xxhash64(whole).alias("key"), whole.alias("text"))
        index = keep(trigram_index(texts, trigrams, max(1, docs.count() // block)), "trigrams", shelf)
        chosen = keep(candidates(index, asked), "candidates")
        clear(spark, shelf)
        rows = rows.join(chosen, "key", "left")
    else:
        rows = rows.withColumn("rules", F.lit(None).cast("array<int>"))
    known = [
        F.struct(
            *[F.lit(v).alias(c) for c, v in (("rank", rank), ("kind", r.kind), ("pattern", r.pattern), ("group", r.group), ("least", r.least), ("base", r.base), ("all", not asked[rank]))]
        )
        for rank, r in enumerate(rules)
    ]
    wanted = F.filter(F.array(*known), lambda r: (r["all"] | F.coalesce(F.array_contains(F.col("rules"), r["rank"]), F.lit(False))) & F.rlike(F.col("text"), r["pattern"]))
    rows = rows.withColumn("wanted", wanted)
    spans = F.array_sort(F.flatten(F.transform("wanted", lambda r: _spans(F.col("text"), r))))
    return rows.select("row.*", spans.alias("secrets"))


def joined(secrets: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secrets_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same in DuckDB's SQL, every rule over every text."""

    def spans(rank: int, rule: Rule) -> str:
        p = rule.pattern.replace("'", "''")
        return f"""
select doc_id, '{rule.kind}' as kind, {rank} as rank, e - length(m) as s, e, {str(rule.base).lower()} as base from (
  select doc_id, unnest(m) as m, unnest(g) as g, unnest(list_transform(range(1, len(m) + 1), lambda k: list_sum(list_transform(range(1, k + 1), lambda i: length(gaps[i]) + length(m[i]))))) as e
  from (select doc_id, regexp_extract_all(text, '{p}', 0) as m, regexp_extract_all(text, '{p}', {rule.group}) as g, regexp_split_to_array(text, '{p}') as gaps from documents
        where regexp_matches(text, '{p}'))) where length(g) >= {rule.least}"""

    every = " union all ".join(f"({spans(k, r)})" for k, r in enumerate(rules))
    line = "string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' order by s, rank)"
    counts = ", ".join(f"coalesce(n_{r.kind}, 0)::bigint as n_{r.kind}" for r in BASE)
    each = ", ".join(f"count(*) filter (kind = '{r.kind}') as n_{r.kind}" for r in BASE)
    return f"""
with s as ({every}),
d as (select doc_id, {each}, {line} filter (base) as base, {line} as spans from s group by doc_id)
select documents.doc_id, {counts}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents left join d using (doc_id)
"""
