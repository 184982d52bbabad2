"""Secret scans over a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams (an OR of ANDs). One pass over the
documents writes the postings of the trigrams that the queries name; postings are intersected by counting, which
gives candidate texts for each rule, and only those are verified with the expression. Rules without mandatory
trigrams, such as long hexadecimal runs, scan every text. DataFrame functions only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm.common import looked_up, materialize, read_table, running_sums
from tidebook.llm.decontamination import text_key


@dataclass(frozen=True)
class Rule:
    """A match counts where its group has `least` characters; matches are leftmost and do not overlap."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Rules every scan has, in the order in which spans at one place are listed.
BASE = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
]
#: Further formats of keys and credentials.
FURTHER = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[0-9A-Za-z_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("url", r"[a-z][a-z0-9+.-]{1,20}://[^\x00-\x20/:@]+:[^\x00-\x20/:@]+@", 0, 1),
]
RULES = BASE + FURTHER

# --- trigram queries ------------------------------------------------------------------------------------------

#: A query is an OR of ANDs of trigrams; None is true for every text.
Query = frozenset[frozenset[str]] | None
#: Sets of strings or clauses that would grow over this are given up, which only makes a query weaker.
MOST = 64


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    joint = frozenset(x | y for x in a for y in b)
    return joint if len(joint) <= MOST else min(a, b, key=len)


def _of_strings(strings: set[str]) -> Query:
    if any(len(s) < 3 for s in strings):
        return None
    clauses = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return frozenset(c for c in clauses if not any(o < c for o in clauses))


def _walk(items) -> tuple[set[str] | None, Query]:
    """(all strings that the sequence can be, or None; the query that each match fulfils besides them)."""
    strings, whole, query = {""}, True, None
    for op, arg in items:
        name, own, need = str(op), None, None
        if name == "LITERAL":
            own = {chr(arg).lower()}
        elif name == "IN":
            singles = [chr(v).lower() for o, v in arg if str(o) == "LITERAL"]
            own = set(singles) if len(singles) == len(arg) <= 8 else None
        elif name == "SUBPATTERN":
            own, need = _walk(arg[3])
        elif name == "BRANCH":
            parts = [_walk(p) for p in arg[1]]
            if all(s is not None for s, _ in parts):
                own = set().union(*(s for s, _ in parts))
            else:
                each = [_both(q, _of_strings(s) if s is not None else None) for s, q in parts]
                need = None if None in each else frozenset().union(*each)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = arg
            found, inside = _walk(inner)
            if low == high == 1:
                own, need = found, inside
            elif low == 0 and int(high) == 1 and found is not None and inside is None:
                own = found | {""}
            elif low > 0:
                need = _both(inside, _of_strings(found) if found is not None else None)
        query = _both(query, need)
        if own is not None and len(strings) * len(own) <= MOST:
            strings = {a + b for a, b in product(strings, own)}
            continue
        query = _both(query, _of_strings(strings))
        strings, whole = (own if own is not None else {""}), False
    if whole:
        return strings, query
    return None, _both(query, _of_strings(strings))


def trigram_query(pattern: str) -> Query:
    """Trigrams of the lower-cased text that every match of a pattern needs; None where it has no mandatory ones."""
    from re import _parser  # the standard library's own syntax tree

    strings, query = _walk(_parser.parse(pattern))
    query = _both(query, _of_strings(strings)) if strings is not None else query
    return None if query is None else frozenset(c for c in query if not any(o < c for o in query))


def _one_of(trigrams: list[str]) -> str:
    """A look-ahead that captures any of the trigrams, grouped by their beginnings so that most places fail at once."""
    tree: dict[str, dict[str, list[str]]] = {}
    for t in sorted(trigrams):
        tree.setdefault(t[0], {}).setdefault(t[1], []).append(t[2])
    q = lambda c: re.escape(c)
    inner = "|".join(q(a) + "(?:" + "|".join(q(b) + "[" + "".join(map(q, cs)) + "]" for b, cs in rest.items()) + ")" for a, rest in tree.items())
    return f"(?=({inner}))[{''.join(map(q, tree))}]"


# --- index and candidates -------------------------------------------------------------------------------------


def clauses(rules: list[Rule]) -> list[tuple[str, int, str, int]]:
    """(kind, clause, trigram, trigrams in the clause) of all rules with mandatory trigrams."""
    out = []
    for rule in rules:
        for n, clause in enumerate(sorted(map(sorted, trigram_query(rule.pattern) or []))):
            out += [(rule.kind, n, t, len(clause)) for t in clause]
    return out


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, key): which texts hold which of the trigrams. Equal texts are one entry."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit(_one_of(trigrams)), F.lit(1)))
    return docs.select(text_key(F.col("text")).alias("key"), F.explode(found).alias("trigram")).distinct().select("trigram", "key")


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """(key, kinds): the rules of which a text fulfils a clause. The clause table is as small as the rules."""
    table = index.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(f"('{k}', {n}, '{t}', {m})" for k, n, t, m in ((k, n, t.replace("'", "\\'"), m) for k, n, t, m in clauses(rules))) + " AS t(kind, clause, trigram, need)")
    met = index.join(F.broadcast(table), "trigram").groupBy("key", "kind", "clause", "need").agg(F.count(F.lit(1)).alias("n"))
    return met.where("n = need").groupBy("key").agg(F.collect_set("kind").alias("kinds"))


# --- verification ---------------------------------------------------------------------------------------------

_SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans (start, rank, kind, end) of a rule's matches that are long enough, in code points, end exclusive."""
    lit = F.lit(rule.pattern)
    if rule.group == 0 and re.fullmatch(r"\[[^\]]*\]\+", rule.pattern):
        lit = F.lit(rule.pattern[:-1] + f"{{{rule.least},}}")  # the same runs, and no short ones to drop
    matches = F.regexp_extract_all(text, lit, F.lit(0))
    judged = F.regexp_extract_all(text, lit, F.lit(rule.group)) if rule.group else matches
    gaps = F.split(text, lit, -1)

    def one(m: Column) -> Column:
        return F.struct((m["end"] - m["length"]).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), m["end"].alias("end"), m["judged"].alias("judged"))

    lengths = F.transform(matches, lambda m: F.length(m))
    ends = running_sums(F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), lengths, lambda gap, n: F.length(gap) + n))
    zipped = F.arrays_zip(ends.alias("end"), lengths.alias("length"), F.transform(judged, lambda j: F.length(j)).alias("judged"))
    kept = F.filter(F.transform(zipped, one), lambda s: s["judged"] >= rule.least)
    return F.when(F.size(matches) > 0, F.transform(kept, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "rank", "kind", "end")]))).otherwise(F.array().cast(_SPANS))


def secrets(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, spans) for each of docs: all spans by start, then by the rule's place in the list.

    Null and empty texts have none. Repeated rows each get a row; extra columns are ignored; no text is cut.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    indexed = {k for k, *_ in clauses(rules)}
    index = materialize(postings(docs, sorted({t for _, _, t, _ in clauses(rules)})), "postings")
    found = materialize(candidates(index, rules), "candidates")
    rows = docs.select("doc_id", text.alias("text")).withColumn("key", text_key(F.col("text")))
    rows = looked_up(rows, found, "key", F.col("doc_id"))
    none = F.array().cast(_SPANS)
    each = [spans(F.col("text"), r, i) if r.kind not in indexed else F.when(F.array_contains("kinds", r.kind), spans(F.col("text"), r, i)).otherwise(none) for i, r in enumerate(rules)]
    return rows.select("doc_id", F.array_sort(F.concat(*each)).alias("spans"))


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(read_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select(
        "doc_id",
        *[count(r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def _rule_sql(rank: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
  SELECT r, start, start + length(whole) AS stop, {rank} AS rank, '{rule.kind}' AS kind FROM (
    SELECT r, whole, judged, list_sum([length(x) FOR x IN gaps[1:i]]) + coalesce(list_sum([length(x) FOR x IN wholes[1 : i - 1]]), 0) AS start FROM (
      SELECT r, unnest(range(1, len(wholes) + 1)) AS i, unnest(wholes) AS whole, unnest(judges) AS judged, wholes, gaps FROM (
        SELECT r, regexp_extract_all(text, '{pattern}') AS wholes, regexp_extract_all(text, '{pattern}', {rule.group}) AS judges, string_split_regex(text, '{pattern}') AS gaps FROM d
        WHERE regexp_matches(text, '{pattern}'))))
  WHERE length(judged) >= {rule.least}"""


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(_rule_sql(i, r) for i, r in enumerate(RULES))}),
g AS (
  SELECT r, {", ".join(f"count(*) FILTER (rank = {i}) AS n_{r.kind}" for i, r in enumerate(BASE))},
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM s GROUP BY r)
SELECT doc_id, {", ".join(f"CAST(coalesce(n_{r.kind}, 0) AS BIGINT) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
"""
