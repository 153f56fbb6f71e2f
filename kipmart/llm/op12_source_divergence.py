"""Source divergence audit (operator 12): how the sources of a language differ
in their words.

1. *Stripes in the mapper.* A task folds whole documents into hash stripes:
   for each (language, term) its document frequency and its count in each
   source. When the stripes held exceed ``held`` entries after folding, they are
   spilled: sent on as rows and begun anew. A row without a term lists a
   language's sources, so sources without terms are known too.
2. *Merge by key.* Stripes are shuffled by (language, term), sorted, and merged as
   a stream: a task holds one merged stripe besides the batch, whatever the
   number of rows of a key. Keys of more than ``fan_in`` mappers are merged in two
   steps, first dealt over parts by mapper. Terms of fewer than
   ``least_docs`` documents go; what is left is stored.
3. *Divergences from the stripes.* With the sums of each (language, source), every
   merged stripe gives directly its share of each pair's divergence and
   its lead over the language. A source's smoothed share of a term that it lacks
   is the same for all terms, so a stripe only adds, for the sources in it, how
   far a pair's difference is from that of two sources without the term; tasks
   fold these into blocks of sums and emit them when ``held`` numbers are kept.
   Of the leading terms each task keeps a source's ``top`` ones.

Shares are whole numbers (1 + floor(10^9 (count + 5) / (N + 5 V))), divided digit
group by digit group, so sums are exact in any order up to N + 5 V = 9 * 10^15.

The result has a row for each ordered pair of sources of a language, so the
list of groups that is sent to the tasks is no longer than the square root of
the result.

Defined cases: null text, language and source are empty ones; a language
without kept terms has pairs of value 0 and no terms; a language's only source
has no pairs; repeated rows count each, null ids too (ids are not read); an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kipmart.llm import common, textvec

LEAST_DOCS, TOP, PRIOR, SCALE_DIGITS = 30, 50, 5, 9
#: Entries held by a task before it spills, and mappers of a key merged at once.
HELD, FAN_IN = 1 << 20, 1024

LETTER = textvec.kind_of([*range(65, 91), *range(97, 123), *range(128, 256)])
STRIPE = pa.schema([("lang", pa.string()), ("term", pa.string()), ("df", pa.int64()),
                    ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("part", pa.int32())])
STRIPE_SQL = "lang string, term string, df long, sources array<string>, counts array<long>, part int"


class Codes:
    """Numbers for names, in the order of their first use."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.code: dict[str, int] = {}

    def of(self, column: pa.Array) -> np.ndarray:
        d = column.dictionary_encode()
        table = np.array([self.one(v) for v in d.dictionary.to_pylist()] or [0], np.int64)
        return table[d.indices.to_numpy(zero_copy_only=False)] if len(column) else table[:0]

    def one(self, name: str) -> int:
        if name not in self.code:
            self.code[name] = len(self.names)
            self.names.append(name)
        return self.code[name]


class Stripes:
    """Hash stripes of a task: (language, term) -> (document frequency, counts
    by source)."""

    def __init__(self, part: int) -> None:
        self.part, self.lang, self.source = part, Codes(), Codes()
        self.clear()

    def clear(self) -> None:
        self.terms: dict[int, tuple[int, str]] = {}  # key -> (language, term)
        self.seen = pd.DataFrame({"lang": [], "source": []}, dtype="int64")
        self.cells = pd.DataFrame({"key": [], "source": [], "n": []}).astype({"key": "uint64", "source": "int64", "n": "int64"})
        self.dfs = pd.DataFrame({"key": [], "n": []}).astype({"key": "uint64", "n": "int64"})
        self.fresh: list[tuple[pd.DataFrame, pd.DataFrame]] = []
        self.size = 0

    def add(self, b: pa.RecordBatch) -> None:
        """The documents (lang, source, text) of a block."""
        lang, source = self.lang.of(b.column(0)), self.source.of(b.column(1))
        self.seen = pd.concat([self.seen, pd.DataFrame({"lang": lang, "source": source})]).drop_duplicates()
        buffer, offs = common.text_buffer(b.column(2))
        w = textvec.words(buffer, offs, LETTER)
        if not len(w.hash):
            return
        doc = w.text_of()
        code, key = pd.factorize(textvec.mix(w.hash + lang[doc].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        first = np.full(len(key), len(code), np.int64)
        np.minimum.at(first, code, np.arange(len(code)))
        low = textvec.LOWER[buffer].tobytes()
        for k, i in zip(key.tolist(), first.tolist()):
            if k not in self.terms:
                self.terms[k] = (int(lang[doc[i]]), low[w.start[i]:w.end[i]].decode())
        once = pd.unique(code * np.int64(b.num_rows) + doc)
        df = np.bincount(once // b.num_rows, minlength=len(key))
        n_sources = len(self.source.names)
        cell, cell_key = pd.factorize(code * np.int64(n_sources) + source[doc])
        cells = pd.DataFrame({"key": key[cell_key // n_sources], "source": cell_key % n_sources, "n": np.bincount(cell)})
        self.fresh.append((cells, pd.DataFrame({"key": key, "n": df})))
        self.size += len(cells)

    def fold(self) -> None:
        if self.fresh:
            self.cells = pd.concat([self.cells, *[c for c, _ in self.fresh]]).groupby(["key", "source"], as_index=False, sort=False).sum()
            self.dfs = pd.concat([self.dfs, *[d for _, d in self.fresh]]).groupby("key", as_index=False, sort=False).sum()
            self.fresh, self.size = [], len(self.cells)

    def spill(self) -> Iterator[pa.RecordBatch]:
        """The stripes as rows; begins anew."""
        self.fold()
        cells, dfs = self.cells.sort_values("key"), self.dfs.sort_values("key")
        names = np.array([*self.source.names, ""], object)
        at = np.searchsorted(cells["key"].to_numpy(), dfs["key"].to_numpy())
        for a in range(0, len(dfs), 20_000):
            d = dfs.iloc[a:a + 20_000]
            bounds = np.append(at[a:a + 20_000], at[a + 20_000] if a + 20_000 < len(at) else len(cells))
            c = cells.iloc[bounds[0]:bounds[-1]]
            of = [self.terms[k] for k in d["key"].tolist()]
            yield stripe_batch([self.lang.names[x] for x, _ in of], [t for _, t in of], d["n"].to_numpy(),
                               names[c["source"].to_numpy()], c["n"].to_numpy(), bounds - bounds[0], self.part)
        seen = self.seen.sort_values("lang", kind="stable")
        langs, start = np.unique(seen["lang"].to_numpy(), return_index=True)
        yield stripe_batch([self.lang.names[x] for x in langs], [""] * len(langs), np.zeros(len(langs), np.int64),
                           names[seen["source"].to_numpy()], np.zeros(len(seen), np.int64),
                           np.append(start, len(seen)), self.part)
        self.clear()


def stripe_batch(lang, term, df, sources, counts, bounds, part) -> pa.RecordBatch:
    offsets = pa.array(np.asarray(bounds, np.int32))
    return common.out_batch(STRIPE, lang=lang, term=term, df=df,
                            sources=pa.ListArray.from_arrays(offsets, pa.array(sources, pa.string())),
                            counts=pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
                            part=np.full(len(df), part, np.int32))


def stripes(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", held: int = HELD) -> DataFrame:
    """Stripe rows of every task; a row with an empty term lists sources."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Stripes(TaskContext.get().partitionId())
        for b in common.blocks(batches, "text"):
            s.add(b)
            if s.size > held:
                s.fold()
                if s.size > held // 2 or len(s.terms) > held:
                    yield from s.spill()
        if len(s.seen):
            yield from s.spill()

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a)
                         for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    return rows.mapInArrow(run, STRIPE_SQL)


def _merge(cells: pa.Table, dfs: pa.Table) -> tuple[pa.Table, pa.Table]:
    return (cells.group_by(["lang", "term", "source"], use_threads=False).aggregate([("n", "sum")]).rename_columns(cells.column_names),
            dfs.group_by(["lang", "term"], use_threads=False).aggregate([("df", "sum")]).rename_columns(dfs.column_names))


def merged(rows: DataFrame, least_docs: int = 0, by_part: int = 1) -> DataFrame:
    """One stripe for each (lang, term), or for each and ``part`` modulo
    ``by_part``; stripes of terms in fewer documents go."""
    keys = ["part", "lang", "term"]

    def flat(b: pa.RecordBatch | pa.Table) -> tuple[pa.Table, pa.Table]:
        t = pa.Table.from_batches([b]).combine_chunks()
        of = pc.list_parent_indices(t["sources"])
        return (pa.table({"lang": t["lang"].take(of), "term": t["term"].take(of), "source": pc.list_flatten(t["sources"]),
                          "n": pc.list_flatten(t["counts"])}), t.select(["lang", "term", "df"]))

    def rows_of(cells: pa.Table, dfs: pa.Table, part: int) -> pa.RecordBatch | None:
        dfs = dfs.filter(pc.or_(pc.greater_equal(dfs["df"], least_docs), pc.equal(dfs["term"], "")))
        if not dfs.num_rows:
            return None
        dfs = dfs.append_column("no", pa.array(np.arange(dfs.num_rows)))
        cells = cells.join(dfs.select(["lang", "term", "no"]), ["lang", "term"], join_type="inner", use_threads=False).sort_by("no")
        bounds = np.searchsorted(cells["no"].to_numpy(), np.arange(dfs.num_rows + 1))
        return stripe_batch(dfs["lang"].combine_chunks(), dfs["term"].combine_chunks(), dfs["df"].to_numpy(),
                            cells["source"].combine_chunks(), cells["n"].to_numpy(), bounds, part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, None  # the stripe that may go on, and its key
        for b in batches:
            if not b.num_rows:
                continue
            part, lang, term = (b.column(b.schema.get_field_index(c)) for c in keys)
            now = (part[-1].as_py(), lang[-1].as_py(), term[-1].as_py())
            same = pc.and_(pc.and_(pc.equal(part, now[0]), pc.equal(lang, now[1])), pc.equal(term, now[2])).to_numpy(zero_copy_only=False)
            cut = int(same.argmax())
            # a part's rows end where the next part's begin
            parts = part.to_numpy()[:cut]
            ends = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), cut]
            for a, z in zip(ends, ends[1:]):
                own = flat(b.slice(a, z - a)) if z > a else None
                if held is not None and (own is None or last[0] != int(parts[a])):
                    if own is None and now == last:
                        continue
                    if (out := rows_of(*held, last[0])) is not None:
                        yield out
                    held = None
                if own is not None:
                    if held is not None:
                        own = tuple(pa.concat_tables([x, y]) for x, y in zip(held, own))
                        held = None
                    if (out := rows_of(*_merge(*own), int(parts[a]))) is not None:
                        yield out
            rest = flat(b.slice(cut))
            if held is not None:
                rest = tuple(pa.concat_tables([x, y]) for x, y in zip(held, rest))
            held, last = _merge(*rest), now
        if held is not None and (out := rows_of(*held, last[0])) is not None:
            yield out

    dealt = rows.withColumn("part", F.pmod("part", F.lit(by_part)))
    return dealt.repartition(common.parallelism(rows.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(run, STRIPE_SQL)


def share(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10**9 * count / total), exact (three digits at a time)."""
    out, rest = np.zeros(np.broadcast(count, total).shape, np.int64), np.asarray(count, np.int64)
    for _ in range(SCALE_DIGITS // 3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return 1 + out


class Language:
    """Sources of a language with their sums over kept terms."""

    def __init__(self, sources: list[str], n: list[int], v: int) -> None:
        order = sorted(range(len(sources)), key=lambda i: sources[i])
        self.sources = [sources[i] for i in order]
        self.index = {s: i for i, s in enumerate(self.sources)}
        self.v = v
        self.total = np.array([n[i] for i in order], np.int64) + PRIOR * v
        self.all = int(sum(n)) + PRIOR * v
        self.base = share(np.full(len(sources), PRIOR, np.int64), self.total) if v else np.zeros(len(sources), np.int64)


_OUT = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
_OUT_SQL = "part string, lang string, source string, item string, value long"
ROWS = 64


class Sums:
    """Sums over the pairs of sources, in blocks of ``ROWS`` sources against all."""

    def __init__(self, languages: dict[str, Language], held: int) -> None:
        self.languages, self.held, self.blocks, self.size = languages, held, {}, 0

    def add(self, lang: str, source: np.ndarray, both: np.ndarray, lone: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows of sums: for each source, over terms that the other has too, and
        over terms that it lacks (these count for the other's row as well)."""
        width = len(self.languages[lang].sources)
        for k in np.unique(source // ROWS):
            at = source // ROWS == k
            if (lang, k) not in self.blocks:
                if self.size and self.size + 2 * ROWS * width > self.held:
                    yield from self.flush()
                self.blocks[lang, k] = np.zeros((2, ROWS, width), np.int64)
                self.size += 2 * ROWS * width
            block = self.blocks[lang, k]
            np.add.at(block[0], source[at] % ROWS, both[at])
            np.add.at(block[1], source[at] % ROWS, lone[at])

    def flush(self) -> Iterator[pa.RecordBatch]:
        for (lang, k), (both, lone) in self.blocks.items():
            names = np.array(self.languages[lang].sources, object)
            mine = names[k * ROWS:(k + 1) * ROWS]
            i, j = np.nonzero(both[:len(mine)])
            a, b = np.nonzero(lone[:len(mine)])
            source = np.concatenate([mine[i], mine[a], names[b]])
            yield common.out_batch(_OUT, part=["pair"] * len(source), lang=[lang] * len(source), source=source,
                                   item=np.concatenate([names[j], names[b], mine[a]]),
                                   value=np.concatenate([both[i, j], lone[a, b], lone[a, b]]))
        self.blocks, self.size = {}, 0


class Leads:
    """The leading terms of every source, ``top`` kept of each."""

    def __init__(self, top: int, held: int) -> None:
        self.top, self.held, self.rows, self.size = top, held, [], 0

    def add(self, t: pa.Table) -> None:
        self.rows.append(t)
        self.size += t.num_rows
        if self.size > self.held:
            self.prune()

    def prune(self) -> None:
        if self.rows:
            t = pa.concat_tables(self.rows).sort_by([("lang", "ascending"), ("source", "ascending"), ("value", "descending"),
                                                     ("item", "ascending")]).combine_chunks()
            name = [t[c].combine_chunks().dictionary_encode().indices.to_numpy() for c in ("lang", "source")]
            fresh = np.ones(t.num_rows, bool)
            fresh[1:] = (name[0][1:] != name[0][:-1]) | (name[1][1:] != name[1][:-1])
            start = np.maximum.accumulate(np.where(fresh, np.arange(t.num_rows), 0))
            t = t.filter(pa.array(np.arange(t.num_rows) - start < self.top))
            self.rows, self.size = [t], t.num_rows
            self.held = max(self.held, 2 * t.num_rows)


def divergences(kept: DataFrame, languages: dict[str, Language], top: int = TOP, held: int = HELD) -> DataFrame:
    """Parts of the sums of pairs, and leading terms, from the merged stripes."""
    shared = kept.sparkSession.sparkContext.broadcast(languages)

    def of_language(lang: str, b: pa.Table, sums: Sums, leads: Leads) -> Iterator[pa.RecordBatch]:
        known = shared.value[lang]
        names = pc.list_flatten(b["sources"]).combine_chunks().dictionary_encode()
        source = np.array([known.index[s] for s in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()]
        count = pc.list_flatten(b["counts"]).to_numpy()
        term = pc.list_parent_indices(b["sources"]).to_numpy()
        p = share(count + PRIOR, known.total[source])
        all_ = share(np.bincount(term, count, b.num_rows).astype(np.int64) + PRIOR, known.all) if count.sum() < 1 << 52 else \
            share(pd.Series(count).groupby(term).sum().reindex(range(b.num_rows), fill_value=0).to_numpy() + PRIOR, known.all)
        lead = p - all_[term]
        some = np.flatnonzero(lead > 0)
        leads.add(pa.table({"lang": pa.array([lang] * len(some), pa.string()),
                            "source": pa.array(known.sources, pa.string()).take(pa.array(source[some])),
                            "item": b["term"].take(pa.array(term[some])), "value": pa.array(lead[some])}))
        width = len(known.sources)
        step = max(1, (1 << 20) // width)
        bounds = np.searchsorted(term, np.arange(b.num_rows + 1))
        a = 0
        while a < b.num_rows:
            # whole terms, so that each row of shares is complete
            z = max(a + 1, min(int(np.searchsorted(bounds, bounds[a] + step, "right")) - 1, a + step, b.num_rows))
            e = slice(bounds[a], bounds[z])
            dense = np.tile(known.base, (z - a, 1))
            there = np.zeros((z - a, width), bool)
            dense[term[e] - a, source[e]] = p[e]
            there[term[e] - a, source[e]] = True
            for f in range(e.start, e.stop, step):
                g = slice(f, min(f + step, e.stop))
                row = term[g] - a
                extra = np.abs(p[g][:, None] - dense[row]) - np.abs(known.base[source[g]][:, None] - known.base)
                yield from sums.add(lang, source[g], np.where(there[row], extra, 0), np.where(there[row], 0, extra))
            a = z

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, leads = Sums(shared.value, 4 * held), Leads(top, held)
        for b in batches:
            t = pa.Table.from_batches([b])
            for lang in pc.unique(t["lang"]).to_pylist():
                yield from of_language(lang, t.filter(pc.equal(t["lang"], lang)).combine_chunks(), sums, leads)
        yield from sums.flush()
        leads.prune()
        for t in leads.rows:
            yield common.out_batch(_OUT, part=["term"] * t.num_rows, **{c: t[c].combine_chunks() for c in t.column_names})

    return kept.where("term <> ''").select("lang", "term", "sources", "counts").mapInArrow(run, _OUT_SQL)


def without_terms(groups: DataFrame, languages: dict[str, Language]) -> DataFrame:
    """Each pair's sum if no source had any of the terms."""
    shared = groups.sparkSession.sparkContext.broadcast(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                known = shared.value[lang]
                i = known.index[source]
                items = known.sources[:i] + known.sources[i + 1:]
                value = np.delete(np.abs(known.base - known.base[i]), i) * known.v
                yield common.out_batch(_OUT, part=["pair"] * len(items), lang=[lang] * len(items), source=[source] * len(items),
                                       item=items, value=value)

    return groups.select("lang", "source").mapInArrow(run, _OUT_SQL)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, text: str = "text", lang: str = "lang",
          source: str = "source", held: int = HELD, fan_in: int = FAN_IN) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group."""
    parts = -(-docs.rdd.getNumPartitions() // fan_in)
    rows = stripes(docs, text, lang, source, held)
    if parts > 1:
        rows = merged(rows, by_part=parts)
    kept = common.stored(merged(rows, least_docs), "stripes")
    groups = common.stored(
        kept.select("lang", F.posexplode("sources").alias("i", "source"), "counts")
        .groupBy("lang", "source").agg(F.sum(F.element_at("counts", F.col("i") + 1)).alias("n")), "groups")
    terms = {r.lang: r.v for r in kept.where("term <> ''").groupBy("lang").agg(F.count("*").alias("v")).collect()}
    listed: dict[str, tuple[list, list]] = {}
    for r in groups.toLocalIterator():
        names, n = listed.setdefault(r.lang, ([], []))
        names.append(r.source)
        n.append(r.n)
    languages = {x: Language(names, n, terms.get(x, 0)) for x, (names, n) in listed.items()}
    found = divergences(kept, languages, top, held)
    found = common.stored(found, "divergences")
    pairs = found.where("part = 'pair'").unionByName(without_terms(groups, languages)) \
        .where("source <> item").groupBy("part", "lang", "source", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return pairs.withColumn("rank", rank).unionByName(
        found.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)) \
        .select("lang", "source", "part", "item", "value", "rank")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences between the sources of each language, all documents."""
    return audit(common.read(spark, sf_dir, "documents"))


ORACLE = r"""
with d as (
  select coalesce(text, '') as t, coalesce(lang, '') as lang, coalesce(source, '') as source,
    row_number() over () as r from documents),
w as (
  select r, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term from w group by lang, term having count(distinct r) >= 30),
v as (select lang, count(*) as v from k group by lang),
c as (select lang, source, term, count(*) as n from w join k using (lang, term) group by lang, source, term),
g as (select distinct lang, source from d),
tot as (
  select lang, source, coalesce(sum(n), 0) as n from g left join c using (lang, source) group by lang, source),
p as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
    1 + (cast(1000000000 as hugeint) * (coalesce(c.n, 0) + 5)) // (tot.n + 5 * v.v) as p
  from g join k on k.lang = g.lang join v on v.lang = g.lang
  join tot on tot.lang = g.lang and tot.source = g.source
  left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
lt as (select lang, sum(n) as n from tot group by lang),
q as (
  select lang, term, 1 + (cast(1000000000 as hugeint) * (sum(c.n) + 5)) // (any_value(lt.n) + 5 * any_value(v.v)) as q
  from c join lt using (lang) join v using (lang) group by lang, term),
pv as (
  select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source
  group by a.lang, a.source, b.source),
pair as (
  select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(pv.value, 0) as bigint) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join pv on pv.lang = a.lang and pv.source = a.source and pv.item = b.source),
lead_ as (
  select p.lang, p.source, 'term' as part, p.term as item, cast(p.p - q.q as bigint) as value
  from p join q on q.lang = p.lang and q.term = p.term where p.n > 0 and p.p > q.q)
select *, cast(row_number() over (partition by lang, source order by value desc, item) as integer) as rank from pair
union all
select * from (select *, cast(row_number() over (partition by lang, source order by value desc, item) as integer) as rank from lead_)
where rank <= 50
"""
