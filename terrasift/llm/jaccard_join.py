"""N-gram Jaccard join with a token-group matrix.

Documents are cut into sets of word shingles; equal sets are one class. Similar classes are partitioned into
groups, each with the union of its members' tokens. A query's overlap with a union bounds its overlap with each
member, so only groups at the bound are opened and compared member by member, exactly.

The matrix's rows are found without comparing every query with every group. Two sets of a and b shingles with
Jaccard similarity t or more differ in at most D = (a + b)(1 - t)/(1 + t) shingles. If shingles are dealt by hash
to m > D cells, at least m - D cells hold the same in both. A cell's content is a token of the matrix: sets that
share fewer than m - D tokens can't be linked, whatever their shingles' frequency in the corpus. A cell holds
several shingles, so a passage or line that many documents share rarely makes a cell of its own, and a document
with fewer shared tokens than it needs for a link leaves before anything is compared.

Stars come first, so that the work stays linear in a group of copies: each token's documents are compared with one
of them only, in two turns. Linked ones form components, and links within a component change no result and are not
looked for. The matrix then finds the links between components. Documents that may have any are sorted by a sketch
of their tokens, so that similar ones are neighbours whether they are linked or not, and cut into groups; groups
that follow each other form a bundle. A document's rarest tokens name the bundles in which it may have a partner; a
bundle's matrix of tokens and groups bounds the document's overlap with each union, and only groups at the bound
are opened. So a passage that many documents share costs a row for each document and bundle, not for each pair: as
a bundle has up to 4096 members, that is the square's 4096th part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrasift.llm.common import _MIX, _hashes, dropped, keep_only, mixed, release, shingles, stored, texts, tune
from terrasift.llm.components import components

#: A group holds GROUP_TOKENS of its members' tokens, a bundle as many groups; an item counts for LEAST_TOKENS at least, so a group has 64 members at most.
GROUP_TOKENS, BUNDLE_GROUPS, LEAST_TOKENS = 1 << 14, 64, 256
#: Queries that one task compares with a group or bundle before they are dealt to several.
GROUP_QUERIES = 512
#: Ids up to this number (16 MB) are broadcast to pick their texts, more are joined by shuffle.
BROADCAST_IDS = 2_000_000
CLASS_RATIO = 1.5
#: Spare cells of the matrix, as a part of those that may differ.
FINE = 2.0
META = 1 << 20


class Scheme:
    """The cells of each size class for one threshold num / den; spare: cells beyond the most that may differ, as a part of these."""

    def __init__(self, num: int, den: int, spare: float = 1 / 6) -> None:
        self.num, self.den, self.spare = num, den, spare
        low = [1]
        while low[-1] < 1 << 40:
            low.append(max(low[-1] + 1, int(low[-1] * CLASS_RATIO)))
        self.low = np.array(low)

    def least_common(self, n: int) -> int:
        return -(-self.num * n // self.den)

    def most_apart(self, both: int) -> int:
        return both * (self.den - self.num) // (self.den + self.num)

    def parts(self, h: np.ndarray) -> list[dict]:
        """Of a set's sorted hashes: for each class in which it may meet a partner, its tokens and how many a partner shares at least."""
        n, out = len(h), []
        if not n:
            return out
        most = n * self.den // self.num
        first, last = (int(np.searchsorted(self.low, x, "right")) - 1 for x in (n, most))
        needy = False
        for c in range(first, last + 1):
            top = int(self.low[c + 1]) - 1
            apart = self.most_apart(2 * top)
            if not apart:
                continue
            m = apart + max(2, int(apart * self.spare))
            cell = ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            starts = np.concatenate(([0], np.flatnonzero(cell[1:] != cell[:-1]) + 1))
            sums = np.add.reduceat(mixed(h ^ _MIX), starts)
            tokens = mixed(sums + (cell[starts] + np.uint64(1)) * _MIX + np.uint64((c + 1) * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF))
            need = m - self.most_apart(n + min(top, most)) - (m - len(starts))
            if need < 1:
                needy, need = True, 1
            out.append({"meta": c * META + min(need, META - 1), "tokens": tokens.view(np.int64)})
        if needy:
            # So many cells are empty that a link may share none else: these meet by their first shingles (prefix filter).
            prefix = h[: n - self.least_common(n) + 1]
            out.append({"meta": 100 * META + 1, "tokens": mixed(prefix ^ np.uint64(0xA5A5A5A5A5A5A5A5)).view(np.int64)})
        return out


def sketches(docs: DataFrame, k: int, scheme: Scheme) -> DataFrame:
    """doc_id, n, s1, s2 (128 bits of the set, null if empty), parts."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("parts", pa.list_(pa.struct([("meta", pa.int64()), ("tokens", pa.list_(pa.int64()))])))])

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("words", _hashes.clear)
        for b in it:
            n, s1, s2, parts = [], [], [], []
            for t in texts(b):
                h = shingles(t, k)
                n.append(len(h))
                d = xxhash.xxh3_128_digest(h.tobytes())
                s1.append(int.from_bytes(d[:8], "little", signed=True) if len(h) else None)
                s2.append(int.from_bytes(d[8:], "little", signed=True) if len(h) else None)
                parts.append(scheme.parts(h))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, f.type) for x, f in zip((n, s1, s2, parts), list(schema)[1:], strict=True))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n long, s1 long, s2 long, parts array<struct<meta:long,tokens:array<long>>>")


def _repeated(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token, those whose token another row has too; one row is held over between batches."""
    held: pa.RecordBatch | None = None
    held_hit = False
    for b in it:
        if not b.num_rows:
            continue
        table = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        token = table.column(0).to_numpy()
        same = token[1:] == token[:-1]
        hit = np.zeros(len(token), bool)
        hit[1:] |= same
        hit[:-1] |= same
        hit[0] |= held_hit
        # The last row waits for its successor.
        yield table.filter(pa.array(hit)).slice(0, int(hit[:-1].sum())) if len(token) > 1 else table.slice(0, 0)
        held, held_hit = table.slice(len(token) - 1), bool(hit[-1])
    if held is not None and held_hit:
        yield held


def shared_tokens(reps: DataFrame) -> DataFrame:
    """(token, doc, meta) of the tokens that two documents or more have, for documents with as many as a link needs."""
    rows = reps.select(F.col("doc_id").alias("doc"), F.explode("parts").alias("p")).select("doc", F.col("p.meta").alias("meta"), F.explode("p.tokens").alias("token")).select("token", "doc", "meta")
    n = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = rows.repartition(n, "token").sortWithinPartitions("token").mapInArrow(_repeated, rows.schema)
    near = stored(near, "tokens")
    release(reps.sparkSession)
    enough = near.groupBy("doc", "meta").agg(F.count("*").alias("c")).where(F.col("c") >= F.col("meta") % META).select("doc", "meta")
    out = stored(near.join(enough, ["doc", "meta"], "left_semi").select("token", "doc", "meta"), "tokens")
    dropped(near)
    release(reps.sparkSession)
    return out


def representatives(known: DataFrame, classes: DataFrame) -> DataFrame:
    """The row of known that each class names by its rid, with its parts.

    Parts are most of what a row holds, so it is the rows' numbers that move, as long as the fewer of those to keep
    and those to leave out can be broadcast.
    """
    n = classes.agg(F.count("*").alias("kept"), F.sum("rows").alias("all")).first()
    if n.kept <= BROADCAST_IDS:
        return known.join(F.broadcast(classes.select("rid")), "rid", "left_semi")
    if n.all - n.kept <= BROADCAST_IDS:
        several = F.broadcast(classes.where("rows > 1").select("s1", "s2", F.col("rid").alias("lead")))
        copies = known.select("rid", "s1", "s2").join(several, ["s1", "s2"]).where(F.col("rid") != F.col("lead")).select("rid")
        return known.join(F.broadcast(copies), "rid", "left_anti")
    return known.join(classes.select("rid"), "rid", "left_semi")


def _pick(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc, text) of the ids given."""
    few = ids.count() <= BROADCAST_IDS
    t = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    return t.join(F.broadcast(ids) if few else ids, "doc", "left_semi")


def _grouped(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], Iterator[tuple]]]:
    """Rows sorted by (at, chunk, kind): of each (at, chunk) the members (kind 0), and an iterator of its queries."""
    rows = (row for b in it for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True))
    for _, own in groupby(rows, itemgetter(0, 1)):
        members, first = [], None
        for row in own:
            if row[2]:
                first = row
                break
            members.append(row)
        if first is not None and members:
            yield members, chain((first,), own)


def _dealt(members: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows at, chunk, kind and the others: queries in chunks of bounded size, the members with each chunk."""
    sizes = asked.groupBy("at").agg(F.ceil(F.count("*") / GROUP_QUERIES).alias("chunks"))
    few = F.pmod(F.xxhash64("doc", "of"), F.col("chunks"))
    asked = asked.join(sizes, "at").select("at", few.alias("chunk"), F.lit(1).alias("kind"), *[c for c in asked.columns if c != "at"])
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    members = members.join(sizes, "at").select("at", every.alias("chunk"), F.lit(0).alias("kind"), *[c for c in members.columns if c != "at"])
    return members.unionByName(asked)


def _sorted(dealt: DataFrame) -> DataFrame:
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "at", "chunk").sortWithinPartitions("at", "chunk", "kind")


def opened(docs: DataFrame, members: DataFrame, asked: DataFrame, k: int, scheme: Scheme) -> DataFrame:
    """Links (a, b) between queries and the members of their groups, both (at, of, doc): of is a document's component.

    Texts travel to the groups that are opened and are cut into shingles there: packed, they take less room than
    sets of hashes do. A worker holds one group's sets at a time, and one query. A query is linked with one member of
    a component at most.
    """

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, c = [], []
        for members, queries in _grouped(it):
            group = [(of, doc, shingles(raw, k)) for _, _, _, of, doc, raw in members]
            for _, _, _, comp, doc, raw in queries:
                h, found = shingles(raw, k), set()
                for of, other, s in group:
                    if of in found or of == comp or other == doc or min(len(s), len(h)) * scheme.den < max(len(s), len(h)) * scheme.num:
                        continue
                    both = _common(h, s)
                    if scheme.den * both >= scheme.num * (len(h) + len(s) - both):
                        a.append(doc)
                        c.append(other)
                        found.add(of)
            if len(a) > 1000:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(c, pa.int64())})
                a, c = [], []
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(c, pa.int64())})

    # The rows are told apart before texts join them, and the texts then go straight to where they are read.
    rows = stored(_dealt(members.select("at", "of", "doc"), asked.select("at", "of", "doc")), "asked")
    full = rows.join(_pick(docs, rows.select("doc").distinct()), "doc").select("at", "chunk", "kind", "of", "doc", F.col("text").cast("binary").alias("raw"))
    out = stored(_sorted(full).mapInArrow(work, "a long, b long"), "links")
    dropped(rows)
    release(docs.sparkSession)
    return out


def qualifying(groups: DataFrame, asked: DataFrame) -> DataFrame:
    """(at, of, doc, meta) of the groups whose union shares `need` tokens with a query. groups: (at: bundle, of: group, tokens), asked: (at, of: component, doc, meta, tokens)."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for members, queries in _grouped(it):
            ids = np.array([m[3] for m in members], np.int64)
            sizes = [len(m[6]) for m in members]
            # The bundle's matrix: a row for each token and group, in order of tokens.
            tokens, group = np.concatenate([np.array(m[6], np.int64) for m in members]), np.repeat(np.arange(len(ids)), sizes)
            order = np.argsort(tokens)
            tokens, group = tokens[order], group[order]
            at, of, docs, metas = [], [], [], []
            for _, _, _, comp, doc, meta, own in queries:
                q = np.array(own, np.int64)
                lo, hi = np.searchsorted(tokens, q), np.searchsorted(tokens, q, "right")
                n = hi - lo
                rows = np.repeat(hi - n.cumsum(), n) + np.arange(n.sum())
                found = ids[np.bincount(group[rows], minlength=len(ids)) >= meta % META].tolist()
                at += found
                of += [comp] * len(found)
                docs += [doc] * len(found)
                metas += [meta] * len(found)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in (("at", at), ("of", of), ("doc", docs), ("meta", metas))})

    members = groups.select("at", "of", F.lit(None).cast("long").alias("doc"), F.lit(None).cast("long").alias("meta"), "tokens")
    return _sorted(_dealt(members, asked.select(*members.columns))).mapInArrow(work, "at long, of long, doc long, meta long")


def _measured(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, of, meta, tokens) in order, with the number of their task and the tokens that stand before them in it."""
    part, before = TaskContext.get().partitionId(), 0
    for b in it:
        sizes = np.maximum(pc.list_value_length(b.column(3)).to_numpy(zero_copy_only=False), LEAST_TOKENS).astype(np.int64)
        ends = before + np.cumsum(sizes)
        before = int(ends[-1]) if len(ends) else before
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(sizes), part, np.int64)), pa.array(ends - sizes), pa.array(sizes)], names=[*b.schema.names, "part", "before", "size"])


def in_groups(items: DataFrame) -> DataFrame:
    """items (doc, of, meta, tokens) with the group g and bundle of each: items of one size class, similar ones together.

    Groups and bundles are cut from one order of all items, so they are as many as the tokens ask for, however many
    tasks there are.
    """
    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The least hashes of a set are a sketch of it (MinHash).
    order = ["class", "m1", "m2", "doc"]
    near = items.withColumns({"class": F.floor(F.col("meta") / META), "m1": F.array_min("tokens"), "m2": F.array_max("tokens")}).repartitionByRange(n, *order).sortWithinPartitions(*order)
    measured = stored(near.select("doc", "of", "meta", "tokens").mapInArrow(_measured, "doc long, of long, meta long, tokens array<long>, part long, before long, size long"), "measured")
    # A row a task.
    totals = measured.groupBy("part").agg(F.sum("size").alias("total"))
    starts = totals.select("part", F.coalesce(F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    at = F.col("start") + F.col("before")
    cut = measured.join(F.broadcast(starts), "part").select("doc", "of", "meta", "tokens", F.floor(at / GROUP_TOKENS).alias("g"), F.floor(at / (GROUP_TOKENS * BUNDLE_GROUPS)).alias("bundle"))
    out = stored(cut, "items")
    dropped(measured)
    return out


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _star_links(docs: DataFrame, tokens: DataFrame, order: Column, k: int, scheme: Scheme) -> DataFrame:
    """Links between each token's documents and its pivot, the first in an order, unless one component has both."""
    pivots = tokens.groupBy("token").agg(F.min_by(F.struct("doc", "comp"), order).alias("pivot"))
    stars = tokens.join(pivots, "token").where(F.col("comp") != F.col("pivot.comp")).select(F.col("pivot.doc").alias("at"), F.col("pivot.comp").alias("pivot"), F.col("comp").alias("of"), "doc").distinct()
    stars = stored(stars, "stars")
    leaders = stars.select("at", F.col("pivot").alias("of"), F.col("at").alias("doc")).distinct()
    out = opened(docs, leaders, stars, k, scheme)
    dropped(stars)
    return out


def _labelled(tokens: DataFrame, comp: DataFrame) -> DataFrame:
    """tokens with their document's component so far, less the tokens that one component has to itself."""
    out = tokens.join(comp.select(F.col("id").alias("doc"), F.col("component")), "doc", "left").select("token", "doc", "meta", F.coalesce("component", "doc").alias("comp"))
    several = out.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(F.col("lo") != F.col("hi")).select("token")
    return out.join(several, "token", "left_semi")


def _matrix_links(docs: DataFrame, labelled: DataFrame, k: int, scheme: Scheme) -> DataFrame:
    """Links between documents of different components, by the token-group matrix.

    A document that must share `need` of its n tokens with a union shares one of its n - need + 1 rarest, so only
    those name bundles.
    """
    items = in_groups(labelled.groupBy("doc", F.col("comp").alias("of"), "meta").agg(F.collect_set("token").alias("tokens")))
    each = items.select("bundle", "doc", "meta", F.explode("tokens").alias("token"))
    bundles = each.groupBy("token").agg(F.collect_set("bundle").alias("bundles"))
    own = W.partitionBy("doc", "meta")
    rare = (
        each.select("doc", "meta", "token").join(bundles, "token")
        .withColumn("nth", F.row_number().over(own.orderBy(F.size("bundles"), "token"))).withColumn("n", F.count("*").over(own))
        .where(F.col("nth") <= F.col("n") - F.col("meta") % META + 1)
    )
    # The bundles of all these tokens are put together before they become rows.
    found = rare.groupBy("doc", "meta").agg(F.array_distinct(F.flatten(F.collect_list("bundles"))).alias("bundles")).select("doc", "meta", F.explode("bundles").alias("bundle"))
    asked = found.join(items.select("doc", "of", "meta", "tokens"), ["doc", "meta"]).select(F.col("bundle").alias("at"), "of", "doc", "meta", "tokens")
    groups = items.groupBy("bundle", "g").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens")).select(F.col("bundle").alias("at"), F.col("g").alias("of"), "tokens")
    bound = stored(qualifying(groups, asked), "bound")
    members = items.join(bound.select(F.col("at").alias("g")).distinct(), "g", "left_semi").select(F.col("g").alias("at"), "of", "doc")
    out = opened(docs, members, bound, k, scheme)
    dropped(items, bound)
    return out


def joined(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of each row: the components of all links num/den or more similar.

    Null, empty and blank texts have no shingles and link with nothing; a text of fewer than k words is one
    shingle. Rows that repeat an id are one document, linked by any of its texts, but keep their own n_shingles.
    A null id has no component (null) and links nothing. Columns besides doc_id and text are not read; an empty
    table gives no rows. Similarity is compared in integers; equal sets are always linked.
    """
    tune(docs.sparkSession)
    scheme = Scheme(num, den)
    all_sets = stored(sketches(docs, k, scheme).withColumn("rid", F.monotonically_increasing_id()), "sets")
    known = all_sets.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    first = F.min_by("rid", F.struct("doc_id", "rid")).alias("rid")
    classes = stored(known.groupBy("s1", "s2").agg(F.min("doc_id").alias("doc_id"), first, F.count("*").alias("rows")), "classes")
    reps = representatives(known, classes)
    tokens = shared_tokens(reps)
    # From here on only the sets' names and sizes are asked for.
    named = stored(all_sets.drop("parts", "rid"), "names")
    dropped(all_sets)
    all_sets, known = named, named.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))

    # Stars: each token's documents against one of them, at first the smallest, then another where components differ.
    links = _star_links(docs, tokens.withColumn("comp", F.col("doc")), F.col("doc"), k, scheme)
    labelled = _labelled(tokens, components(links))
    links = links.unionByName(_star_links(docs, labelled, F.xxhash64("doc", "token"), k, scheme))
    comp = components(links)
    # Documents that may have links left get finer cells, of which a link has many in common and other pairs few.
    left = stored(_labelled(tokens, comp).select("doc").distinct(), "left")
    fine_sets = stored(sketches(_pick(docs, left).withColumnRenamed("doc", "doc_id"), k, Scheme(num, den, FINE)), "fine")
    fine = shared_tokens(fine_sets)
    dropped(fine_sets)
    labelled = _labelled(fine, comp)
    enough = labelled.groupBy("doc", "meta").agg(F.count("*").alias("c")).where(F.col("c") >= F.col("meta") % META).select("doc", "meta")
    labelled = stored(labelled.join(enough, ["doc", "meta"], "left_semi"), "labelled")
    links = links.unionByName(_matrix_links(docs, labelled, k, scheme))
    dropped(tokens, left, fine, labelled)

    same = known.join(classes.select("s1", "s2", F.col("doc_id").alias("rep")), ["s1", "s2"]).where(F.col("doc_id") != F.col("rep")).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    final = components(links.unionByName(same))
    out = all_sets.select("doc_id", "n").join(final, F.col("doc_id") == F.col("id"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs less all rows but one of each component: the row of the smallest id (of the least text, if it repeats).

    Rows with a null id stay. Columns are unchanged.
    """
    comp = joined(docs, k, num, den)
    lead = comp.where(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct()
    few = lead.count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(lead) if few else lead, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    twice = comp.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("c")).where(F.col("c") > 1)
    if not twice.head(1):
        return kept
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("text"))
    once = kept.where(F.col("doc_id").isNotNull()).withColumn("__n", n).where("__n = 1").drop("__n")
    return once.unionByName(kept.where(F.col("doc_id").isNull()))
