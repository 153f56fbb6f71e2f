"""Secret scans (operator 13): spans of keys, tokens and random strings in texts.

All of it is one projection of Spark SQL functions: no Python, no shuffle.

*Given kinds.* ``assign``: a name such as ``password`` or ``api_key``, a colon or equals
sign and a value of 8 characters or more; ``access``: ``AKIA`` and 12 or more
capitals and digits; ``hex``: 32 or more hexadecimal digits. Each kind is found by
its own pattern, leftmost and without overlaps; a match whose value is too short
is consumed and dropped. Places come from the lengths of the matches and of
the pieces between them, added up in chunks, so the work is linear in the text
but for a square root of the matches.

*Random strings.* Candidates are runs of 20 or more characters of the base64
alphabets. A window of 20 characters slides over a candidate; the counts of its
characters and the sum of ``c log2 c`` over them are updated by the character that
comes in and the one that leaves, so a step costs the same for any window. The
Shannon entropy of a window is ``log2(20) - sum / 20`` bits; it is compared with the
limit of the candidate's character class (``hex``: only hexadecimal digits,
3.0 bits; ``base64``: 3.8 bits). Windows over the limit that touch or overlap are one
span, of kind ``random_hex`` or ``random_base64``. Logarithms are a table of whole numbers,
so equal windows compare equally wherever they stand.

*Allow-list.* Candidates that one of ``ALLOWED`` matches (words, numbers, paths
of words, UUIDs, alphabets, stated examples) give no random spans. It never
suppresses a span of a given kind.

Spans are in code points, end exclusive, ordered by start, then kind as listed,
then end; spans of different kinds may overlap.

Defined cases: a null text is empty; empty and blank texts have no spans; rows come
out as they come in, repeated ones each; null ids stay; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kipmart.llm import common

# The patterns of the given kinds and the lengths that they must have.
ASSIGN = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
          r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LEAST_VALUE = 8

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
HEX_ONLY = r"^([0-9a-f]+|[0-9A-F]+)$"
#: Bits a character that a window must have, by class.
LIMITS = {"hex": 3.0, "base64": 3.8}
ALPHABETS = {"hex": "0123456789abcdef",
             "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"}
#: Candidates that are no secrets: numbers, words, words joined by signs, UUIDs,
#: alphabets in order, and texts that call themselves examples.
ALLOWED = (
    r"^[0-9]+$",
    r"^[A-Z]?[a-z]+$",
    r"^[A-Z]+$",
    r"^[+/_=-]*[A-Za-z]?[a-z]+([+/_=-]+[A-Za-z]?[a-z]+)*[+/_=-]*$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"[Aa][Bb][Cc][Dd][Ee][Ff][Gg][Hh]|01234567|12345678",
    r"[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Ss][Aa][Mm][Pp][Ll][Ee]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]|[Dd][Uu][Mm][Mm][Yy]",
)
KINDS = ("assign", "access", "hex", "random_hex", "random_base64")
#: c log2 c in millionths, for the counts of a window.
LOGS = [round(1e6 * c * math.log2(c)) if c else 0 for c in range(WINDOW + 1)]
CHUNK = 256

SPANS = "array<struct<start:int,kind:int,end:int>>"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _indexes(n: Column) -> Column:
    """0 to n - 1; none for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _running(sizes: Column, start: Column) -> Column:
    """For each size, ``start`` and the sizes before it."""
    zero = F.struct(F.array().cast("array<int>").alias("a"), start.alias("t"))
    return F.aggregate(sizes, zero, lambda acc, s: F.struct(
        F.concat(acc["a"], F.array(acc["t"])).alias("a"), (acc["t"] + s).alias("t")), lambda acc: acc["a"])


def starts_of(sizes: Column) -> Column:
    """Sum of the sizes before each one, by chunks: a chunk's own sums are short
    lists, so no list of all sums is copied for each size."""
    def of(s: Column) -> Column:
        chunks = F.transform(_indexes(F.ceil(F.size(s) / F.lit(CHUNK)).cast("int")),
                             lambda i: F.slice(s, i * CHUNK + 1, F.lit(CHUNK)))
        return _let(chunks, lambda c: F.flatten(F.zip_with(
            c, _running(F.transform(c, lambda x: F.aggregate(x, F.lit(0), lambda t, v: t + v)), F.lit(0)), _running)))
    return _let(sizes, of)


def _spans(matches: Column, pieces: Column, kind: int, keep: Column | None = None) -> Column:
    """Spans of all matches of a pattern, given the pieces between them; those
    whose ``keep`` length is too short go."""
    def of(m: Column, p: Column) -> Column:
        sizes = F.zip_with(m, F.slice(p, 1, F.size(m)), lambda x, y: F.char_length(x) + F.char_length(y))
        spans = F.zip_with(F.zip_with(starts_of(sizes), F.slice(p, 1, F.size(m)), lambda s, y: s + F.char_length(y)), m,
                           lambda s, x: F.struct(s.alias("start"), F.lit(kind).alias("kind"),
                                                 (s + F.char_length(x)).alias("end")))
        if keep is None:
            return spans
        return F.transform(F.filter(F.arrays_zip(spans.alias("s"), keep.alias("v")),
                                    lambda x: F.char_length(x["v"]) >= LEAST_VALUE), lambda x: x["s"])
    return _let(matches, lambda m: _let(pieces, lambda p: of(m, p)))


def found(text: Column, pattern: str, kind: int, value: int | None = None) -> Column:
    """Spans of a pattern in the text; with ``value``, only those whose group
    of that number is long enough."""
    keep = None if value is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(value))
    spans = _spans(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), kind, keep)
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(F.array().cast(SPANS)).cast(SPANS)


def random_windows(string: Column, alphabet: str, limit: float) -> Column:
    """Spans (start, end) of a string's windows over the limit of entropy; the
    string has characters of the alphabet only."""
    most = round(1e6 * WINDOW * (math.log2(WINDOW) - limit))  # of the sum of c log2 c
    logs = F.array(*[F.lit(v).cast("long") for v in LOGS])
    codes = F.transform(F.regexp_extract_all(string, F.lit("."), F.lit(0)), lambda c: F.instr(F.lit(alphabet), c))
    spans = "array<struct<start:int,end:int>>"

    def fold(code: Column, log: Column) -> Column:
        zero = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("count"), F.lit(0).cast("long").alias("sum"),
                        F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.array().cast(spans).alias("out"))

        def step(acc: Column, i: Column) -> Column:
            comes = F.element_at(code, i + 1)
            goes = F.when(i >= WINDOW, F.element_at(code, i - WINDOW + 1)).otherwise(0)
            return _let(F.struct(comes.alias("comes"), goes.alias("goes")), lambda x: changed(acc, i, x["comes"], x["goes"]))

        def changed(acc: Column, i: Column, comes: Column, goes: Column) -> Column:
            same = comes == goes
            up, down = F.element_at(acc["count"], comes), F.element_at(acc["count"], F.greatest(goes, F.lit(1)))
            total = F.when(same, acc["sum"]).otherwise(
                acc["sum"] + F.element_at(log, up + 2) - F.element_at(log, up + 1)
                + F.when(goes > 0, F.element_at(log, down) - F.element_at(log, down + 1)).otherwise(F.lit(0).cast("long")))
            count = F.when(same, acc["count"]).otherwise(F.transform(
                acc["count"], lambda c, j: c + (j + 1 == comes).cast("int") - (j + 1 == goes).cast("int")))
            return _let(F.struct(total.alias("sum"), count.alias("count")), lambda n: moved(acc, n, i))

        def moved(acc: Column, n: Column, i: Column) -> Column:
            first = i - (WINDOW - 1)
            over = (first >= 0) & (n["sum"] <= most)
            new = over & (first > acc["end"])
            return F.struct(
                n["count"].alias("count"), n["sum"].alias("sum"),
                F.when(new, first).otherwise(acc["start"]).alias("start"),
                F.when(over, i + 1).otherwise(acc["end"]).alias("end"),
                F.when(new & (acc["start"] >= 0), pushed(acc)).otherwise(acc["out"]).alias("out"))

        def pushed(acc: Column) -> Column:
            return F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))

        return F.aggregate(_indexes(F.size(code)), zero, step,
                           lambda acc: F.when(acc["start"] >= 0, pushed(acc)).otherwise(acc["out"]))

    return _let(codes, lambda code: _let(logs, lambda log: fold(code, log)))


def random_spans(text: Column, limits: dict[str, float] = LIMITS, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """Spans of random strings of the text."""
    hex_kind, base64_kind = KINDS.index("random_hex"), KINDS.index("random_base64")

    def of(s: Column, start: Column) -> Column:
        is_hex = F.regexp_like(s, F.lit(HEX_ONLY))
        windows = F.when(is_hex, random_windows(F.lower(s), ALPHABETS["hex"], limits["hex"])) \
            .otherwise(random_windows(s, ALPHABETS["base64"], limits["base64"]))
        return F.transform(windows, lambda w: F.struct(
            (w["start"] + start).alias("start"), F.when(is_hex, hex_kind).otherwise(base64_kind).alias("kind"),
            (w["end"] + start).alias("end")))

    def candidates(m: Column, spans: Column) -> Column:
        rows = F.arrays_zip(m.alias("s"), spans.alias("p"))
        if allowed:
            rows = F.filter(rows, lambda x: ~F.regexp_like(x["s"], F.lit("|".join(allowed))))
        return F.flatten(F.transform(rows, lambda x: of(x["s"], x["p"]["start"])))

    out = _let(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda m: candidates(
        m, _spans(m, F.split(text, CANDIDATE, -1), hex_kind)))
    return F.when(F.regexp_like(text, F.lit(CANDIDATE)), out).otherwise(F.array().cast(SPANS)).cast(SPANS)


def scan(docs: DataFrame, text: str = "text", name: str = "secrets", limits: dict[str, float] = LIMITS,
         allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """The rows with ``name``: array of (start, kind, end), kind an index of ``KINDS``."""
    t = F.coalesce(F.col(text), F.lit(""))
    given = [found(t, ASSIGN, 0, value=2), found(t, ACCESS, 1), found(t, HEX, 2)]
    return docs.withColumn(name, F.array_sort(F.concat(*given, random_spans(t, limits, allowed))))


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of all documents."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    s = F.col("secrets")
    base = F.filter(s, lambda x: x["kind"] < 3)

    def number(kind: int) -> Column:
        return F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return scan(docs).select(
        "doc_id", *map(number, range(3)),
        F.sha2(as_text(base), 256).alias("base_sha256"), as_text(s).alias("spans"))


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _oracle() -> str:
    """The same spans from rows: windows counted one by one, islands by gaps."""
    kinds = [(ASSIGN, 0), (ACCESS, 1), (HEX, 2), (CANDIDATE, 9)]
    value = f"regexp_extract_all(t, {_sql_text(ASSIGN)}, 2)"
    of_kind = "\n  union all\n".join(
        f"  select r, {k} as kind, unnest(regexp_extract_all(t, {_sql_text(p)})) as m, "
        f"unnest(regexp_split_to_array(t, {_sql_text(p)})[:-2]) as piece, "
        f"unnest({value if not k else f'regexp_extract_all(t, {_sql_text(p)})'}) as v, "
        f"unnest(range(len(regexp_extract_all(t, {_sql_text(p)})))) as i from d where regexp_matches(t, {_sql_text(p)})"
        for p, k in kinds)
    most = {c: round(1e6 * WINDOW * (math.log2(WINDOW) - x)) for c, x in LIMITS.items()}
    allow = " or ".join(f"regexp_matches(m, {_sql_text(p)})" for p in ALLOWED)
    return f"""
with d as (select doc_id, coalesce(text, '') as t, row_number() over () as r from documents),
hit as (
{of_kind}),
placed as (
  select r, kind, m, v, cast(sum(length(piece) + length(m)) over (partition by r, kind order by i) - length(m) as bigint) as a
  from hit),
given as (select r, kind, a, a + length(m) as z from placed where kind < 3 and (kind > 0 or length(v) >= {LEAST_VALUE})),
cand as (
  select r, a, m, case when regexp_matches(m, {_sql_text(HEX_ONLY)}) then 3 else 4 end as kind
  from placed where kind = 9 and not ({allow})),
win as (
  select r, kind, a + j as a, substr(case when kind = 3 then lower(m) else m end, j + 1, {WINDOW}) as s
  from (select *, unnest(range(length(m) - {WINDOW} + 1)) as j from cand)),
chars as (select r, kind, a, c, count(*) as n from (select *, unnest(string_split(s, '')) as c from win) group by r, kind, a, c),
over_ as (
  select r, kind, a from chars, (select {LOGS}::bigint[] as g) group by r, kind, a
  having sum(g[n + 1]) <= case when kind = 3 then {most['hex']} else {most['base64']} end),
island as (
  select *, sum(fresh) over (partition by r, kind order by a) as no from (
    select *, case when a - lag(a) over (partition by r, kind order by a) <= {WINDOW} then 0 else 1 end as fresh from over_)),
spans as (
  select * from given union all
  select r, kind, min(a), max(a) + {WINDOW} from island group by r, kind, no),
named as (select r, kind, a, z, {list(KINDS)}[kind + 1] || ':' || a || ':' || z as s from spans)
select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access,
  count(*) filter (kind = 2) as n_hex,
  sha256(coalesce(string_agg(s, ',' order by a, kind, z) filter (kind < 3), '')) as base_sha256,
  coalesce(string_agg(s, ',' order by a, kind, z), '') as spans
from d left join named using (r) group by r, doc_id
"""


ORACLE = _oracle()
