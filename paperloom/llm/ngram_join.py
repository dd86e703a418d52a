"""N-gram Jaccard join by a grouped prefix join.

A document's set is its distinct 5-word shingles (64-bit hashes).  Two sets with a Jaccard
similarity of at least t share a token within their first n - ceil(t n) + 1 tokens of
any global order.  The order here is (magnitude of the token's count, hash): rare tokens come
first, by a count-min sketch over all documents (`_blocks.Sketch`).  Tokens that the sketch
counts once can't be shared, so they leave the prefixes, and a document with less than
t of its tokens counted twice or more has no link at all.

1. Equal sets are collapsed into one representative.
2. Representatives with identical prefixes and size form a group; members are checked
   against the group's first one, groups against the one that they share most prefix tokens
   with.  That is linear and finds what hangs together in large groups of copies.
3. Groups are joined by prefix token, filtered by size and token position, only where they
   hold different components so far.  A pair of groups compares its first members; what that
   does not join is expanded into members.  Jaccard distance is a metric, so a member whose
   distance to its group's first one is too small to bridge the distance of the two first ones
   is left out.  The member pairs are verified: few ones as joined rows, those of larger groups, and of
   tokens that more than ``HOT`` groups hold, in blocks of members that a task compares in place.
   So no link between components is lost, and pairs within a component that is known already are
   never made.

Defined cases: a null or empty text, or one without words, has an empty set and links with nothing; fewer than five words
make one shingle of the whole sequence; rows with a null doc_id link like others but give
no component number (a component of such rows alone has none); rows that repeat a doc_id are rows of
their own with the same number or that of their component; an empty table gives an empty result; other
columns are ignored.  `first_of_each` chooses by row: of a component it keeps one row, that with the smallest doc_id
(null last), also where rows share this id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from paperloom.llm._blocks import ROW_BITS, Sketch, answers_of, as_before, carried, load, with_answers, write_blocks
from paperloom.llm._components import components
from paperloom.llm._session import materialize, written
from paperloom.llm._words import buffers, whole_hash, window_hashes, word_hashes, word_spans

SHINGLE = 5
PERCENT = 80
HOT = 64  # tokens with more holders are compared block by block
HOT_PAIRS = 1024  # and so are pairs of groups with more pairs of members
HOT_BLOCK = 384


def _shingle_sets(table: pa.Table, k: int) -> list[np.ndarray]:
    data, offs = buffers(table["text"])
    starts, ends, first = word_spans(data, offs)
    words = word_hashes(data, starts, ends, lower=True)
    grams = window_hashes(words, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        else:
            out.append(np.array([whole_hash(words[a:b])] if b > a else [], dtype=np.uint64))
    return out


def _flat(sets: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def _prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


_SETS = "uid long, doc_id long, n long, set_key binary, group_key binary, skip int, tokens array<long>"


def _uids(block_id: int, n: int) -> pa.Array:
    return pa.array((block_id << ROW_BITS) + np.arange(n, dtype=np.int64))


def _sets(blocks: DataFrame, k: int, percent: int) -> DataFrame:
    sketch = Sketch(blocks, lambda table: _flat(_shingle_sets(table, k)))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block_id, payload, answers in zip(batch["block_id"].to_pylist(), batch["payload"], batch["answers"], strict=True):
                table = load(payload.as_buffer())
                sets = _shingle_sets(table, k)
                codes = sketch.decode(_flat(sets), answers_of(answers).get(0, {}))
                set_keys, group_keys, skips, tokens, at = [], [], [], [], 0
                for s in sets:
                    code, at = codes[at : at + len(s)], at + len(s)
                    single = int((code == 0).sum())
                    if not len(s) or 100 * (len(s) - single) < percent * len(s):
                        for x in (set_keys, group_keys, skips, tokens):
                            x.append(None)
                        continue
                    ordered = s[np.argsort(code, kind="stable")]
                    prefix = ordered[single : _prefix_length(len(s), percent)]
                    set_keys.append(hashlib.md5(s.tobytes()).digest())
                    group_keys.append(hashlib.md5(prefix.tobytes() + b"%d %d" % (len(s), single)).digest() if len(prefix) else None)
                    skips.append(single)
                    tokens.append(ordered.view(np.int64))
                yield pa.RecordBatch.from_pydict({
                    "uid": _uids(block_id, len(sets)),
                    "doc_id": table["doc_id"].combine_chunks(),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "set_key": pa.array(set_keys, pa.binary()),
                    "group_key": pa.array(group_keys, pa.binary()),
                    "skip": pa.array(skips, pa.int32()),
                    "tokens": pa.array(tokens, pa.list_(pa.int64())),
                })

    return materialize(with_answers(blocks, materialize(sketch.codes())).mapInArrow(order, _SETS))


def _overlaps(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) of representatives with their sizes and what they have in common."""
    side = lambda c: reps.select(F.col("uid").alias(c), F.col("n").alias(f"n_{c}"), F.col("tokens").alias(f"t_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select(*pairs.columns, "n_a", "n_b", F.size(F.array_intersect("t_a", "t_b")).alias("common"))


def _links(overlaps: DataFrame, percent: int) -> DataFrame:
    return overlaps.where(F.lit(100) * F.col("common") >= F.lit(percent) * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def _compared(x: DataFrame, y: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components among the rows (key, uid, comp) of x and y with one key.

    Both sides are dealt into blocks, and a task compares two blocks: it counts
    common tokens in place and returns only links that join components not joined yet, so what it
    returns is linear in its input, however many pairs it has compared.
    """
    blocks = lambda side, c: side.groupBy("key").agg(F.ceil(F.count("*") / HOT_BLOCK).cast("int").alias(c))
    dealt = lambda salt, n: F.pmod(F.xxhash64("uid", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sizes = written(blocks(x, "nx").join(blocks(y, "ny"), "key"))
    x = x.join(sizes, "key").select("key", "uid", "comp", F.lit(True).alias("brief"), dealt(1, "nx").alias("bx"), every("ny").alias("by"))
    y = y.join(sizes, "key").select("key", "uid", "comp", F.lit(False).alias("brief"), every("nx").alias("bx"), dealt(2, "ny").alias("by"))
    tasks = x.unionByName(y).join(reps.select("uid", "tokens"), "uid")

    def compare(table: pa.Table) -> pa.Table:
        brief = np.asarray(table["brief"].combine_chunks())
        uid, comp = (np.asarray(table[c].combine_chunks()) for c in ("uid", "comp"))
        lists = table["tokens"].combine_chunks()
        ends = np.asarray(lists.offsets, dtype=np.int64)
        _, local = np.unique(np.asarray(lists.flatten()), return_inverse=True)
        sets = [local[a:b] for a, b in zip(ends[:-1] - ends[0], ends[1:] - ends[0], strict=True)]
        sizes = np.diff(ends)
        # the component with most holders comes last, and its own members skip it
        mine = np.flatnonzero(~brief)
        names, counts = np.unique(comp[mine], return_counts=True)
        main = names[np.argmax(counts)] if len(names) else -1
        mine = mine[np.argsort(comp[mine] == main, kind="stable")]
        others = int((comp[mine] != main).sum())
        flat = np.concatenate([sets[i] for i in mine]) if len(mine) else local[:0]
        starts = np.concatenate([[0], np.cumsum(sizes[mine])])
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.setdefault(c, c) != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        mark = np.zeros(int(local.max(initial=-1)) + 1, dtype=np.int32)
        a, b = [], []
        for i in np.flatnonzero(brief):
            upto = others if comp[i] == main else len(mine)
            if not upto:
                continue
            mark[sets[i]] = 1
            common = np.add.reduceat(mark[flat[: starts[upto]]], starts[:upto])
            mark[sets[i]] = 0
            for j in np.flatnonzero((100 * common >= percent * (sizes[i] + sizes[mine[:upto]] - common)) & (comp[mine[:upto]] != comp[i])):
                u, v = find(int(comp[i])), find(int(comp[mine[j]]))
                if u != v:
                    root[u] = v
                    a.append(int(uid[i]))
                    b.append(int(uid[mine[j]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return tasks.groupBy("key", "bx", "by").applyInArrow(compare, "a long, b long")


def _renamed(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` with comp replaced by the label of its component among ``links`` (a, b) of comps."""
    label = components(links).select(F.col("node").alias("comp"), "label")
    return comps.join(label, "comp", "left").withColumn("comp", F.coalesce("label", "comp")).drop("label")


def _between(found: DataFrame, comps: DataFrame) -> DataFrame:
    """Links of representatives as links of their components."""
    of = lambda c: comps.select(F.col("uid").alias(c), F.col("comp").alias(f"comp_{c}"))
    return written(found.join(of("a"), "a").join(of("b"), "b").where("comp_a <> comp_b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")).distinct())


def _expanded(pairs: DataFrame, comps: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the members of pairs (gid_x, comp_x, gid_y, comp_y, apart)."""
    reach = comps.groupBy("gid", "comp").agg(F.max("far").alias("reach"), F.count("*").alias("m"))
    for s in "xy":
        pairs = pairs.join(reach.select(*[F.col(c).alias(f"{c}_{s}") for c in reach.columns]), [f"gid_{s}", f"comp_{s}"])
    slack = 1 - percent / 100 + 1e-9
    pairs = written(pairs.where(F.col("apart") <= F.col("reach_x") + F.col("reach_y") + F.lit(slack)))
    large = F.col("m_x") * F.col("m_y") > HOT_PAIRS
    side = lambda c, s: comps.select(F.col("uid").alias(c), F.col("gid").alias(f"gid_{s}"), F.col("comp").alias(f"comp_{s}"), F.col("far").alias(f"far_{s}"))
    few = pairs.where(~large).join(side("a", "x"), ["gid_x", "comp_x"]).join(side("b", "y"), ["gid_y", "comp_y"])
    few = few.where(F.col("apart") <= F.col("far_x") + F.col("far_y") + F.lit(slack)).select("a", "b")
    many = pairs.where(large).withColumn("key", F.xxhash64("gid_x", "comp_x", "gid_y", "comp_y"))

    def bridging(s: str, other: str) -> DataFrame:
        rows = many.join(side("uid", s), [f"gid_{s}", f"comp_{s}"])
        return rows.where(F.col("apart") <= F.col(f"far_{s}") + F.col(f"reach_{other}") + F.lit(slack)).select("key", "uid", F.col(f"comp_{s}").alias("comp"))

    return _links(_overlaps(few, reps), percent).unionByName(_compared(bridging("x", "y"), bridging("y", "x"), reps, percent))


def _all_components(blocks: DataFrame, shingle: int, percent: int) -> DataFrame:
    """uid, doc_id, n_shingles, component_id and keeper (the uid of the component's first row) of each row."""
    sets = _sets(blocks, shingle, percent)
    linked = sets.where("set_key IS NOT NULL")
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col("uid").alias("keeper")))
    equal = written(linked.groupBy("set_key").agg(F.min("uid").alias("uid"), first_row.alias("first_row")))
    reps = materialize(linked.join(equal.select("uid"), "uid", "left_semi").select("uid", "n", "group_key", "skip", "tokens"))

    # groups of identical prefix and size
    groups = written(reps.where("group_key IS NOT NULL").groupBy("group_key").agg(F.min("uid").alias("gid")))
    members = written(reps.select("uid", "group_key").join(groups, "group_key").select("uid", "gid"))
    length = F.expr(f"int(n - (({percent} * n + 99) div 100) + 1 - skip)")
    heads = reps.join(groups.select(F.col("gid").alias("uid")), "uid", "left_semi")
    prefix = written(heads.select(F.col("uid").alias("gid"), "n", "skip", F.posexplode(F.slice("tokens", F.col("skip") + 1, length)).alias("i", "token")).select("token", "gid", "n", (F.col("skip") + F.col("i")).alias("pos")))

    # linear: each group with the one it shares most prefix tokens with, members with their group's first
    leaders = written(prefix.groupBy("token").agg(F.min("gid").alias("lead"), F.count("*").alias("m")).where("m > 1").select("token", "lead"))
    shared = prefix.join(leaders, "token").where("gid <> lead").groupBy("gid", "lead").agg(F.count("*").alias("m"))
    nearest = shared.groupBy("gid").agg(F.max_by("lead", F.struct("m", -F.col("lead"))).alias("b")).withColumnRenamed("gid", "a")
    within = members.where("uid <> gid").select(F.col("uid").alias("a"), F.col("gid").alias("b"))
    first = written(_overlaps(within.union(nearest), reps))
    apart = F.lit(1.0) - F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))
    far = first.select(F.col("a").alias("uid"), F.col("b").alias("gid"), apart.alias("far"))
    comps = members.join(far, ["uid", "gid"], "left").select("uid", "gid", F.coalesce("far", F.lit(0.0)).alias("far"), F.col("uid").alias("comp"))
    comps = written(_renamed(comps, _links(first, percent)))

    # the rest, exactly: pairs that share a token and belong to different components
    held = comps.select("gid", "comp").distinct()
    rows = written(prefix.join(held, "gid").select("token", "gid", "comp", "n", "pos"))
    # a smaller set needs only the first n - ceil(2t/(1+t) n) + 1 of its tokens to meet a larger one
    brief = F.col("pos") <= F.expr(f"n - (({2 * percent} * n + {99 + percent}) div {100 + percent})")
    per_token = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"), F.sum(brief.cast("long")).alias("m_brief"))
    mixed = written(per_token.where("lo < hi AND m_brief > 0").select("token", "m"))

    few = rows.join(mixed.where(F.col("m") <= HOT), "token", "left_semi")
    x = few.where(brief).select("token", *[F.col(c).alias(f"{c}_x") for c in ("gid", "comp", "n", "pos")])
    y = few.select("token", *[F.col(c).alias(f"{c}_y") for c in ("gid", "comp", "n", "pos")])
    most = F.least("pos_x", "pos_y") + 1 + F.least(F.col("n_x") - F.col("pos_x") - 1, F.col("n_y") - F.col("pos_y") - 1)
    smaller = F.struct("n_x", "gid_x", "comp_x") < F.struct("n_y", "gid_y", "comp_y")
    fits = smaller & (F.col("comp_x") != F.col("comp_y")) & (100 * F.col("n_x") >= percent * F.col("n_y")) & ((100 + percent) * most >= percent * (F.col("n_x") + F.col("n_y")))
    pairs = written(x.join(y, "token").where(fits).select("gid_x", "comp_x", "gid_y", "comp_y").distinct())
    # the groups' first members; members of one group are known to share its prefix, so their distance to it is all that is missing
    met = written(_overlaps(pairs.select(F.col("gid_x").alias("a"), F.col("gid_y").alias("b")).distinct(), reps).withColumn("apart", apart))
    joined = components(_between(_links(met, percent), comps))
    open_pairs = pairs.join(met.select(F.col("a").alias("gid_x"), F.col("b").alias("gid_y"), "apart"), ["gid_x", "gid_y"])
    for s in "xy":
        open_pairs = open_pairs.join(joined.select(F.col("node").alias(f"comp_{s}"), F.col("label").alias(f"now_{s}")), f"comp_{s}", "left")
    now = lambda s: F.coalesce(f"now_{s}", f"comp_{s}")
    open_pairs = open_pairs.where(now("x") != now("y")).select("gid_x", "comp_x", "gid_y", "comp_y", "apart")
    second = _links(met, percent).unionByName(_expanded(open_pairs, comps, reps, percent))

    hot = rows.withColumn("brief", brief).join(mixed.where(F.col("m") > HOT), "token", "left_semi")
    hot = hot.join(comps.select("uid", "gid", "comp"), ["gid", "comp"]).select(F.col("token").alias("key"), "uid", "comp", "brief")
    second = second.unionByName(_compared(hot.where("brief").drop("brief"), hot.drop("brief"), reps, percent))
    final = _renamed(comps.select("uid", "comp"), _between(second, comps))

    # back from representatives to all rows
    named = written(equal.join(final, "uid", "left").select("set_key", "first_row", F.coalesce("comp", "uid").alias("c")))
    least = named.groupBy("c").agg(F.min("first_row").alias("least"))
    of_set = written(named.join(written(least), "c").select("set_key", F.col("least.doc_id").alias("component_id"), F.col("least.keeper").alias("keeper")))
    out = ("uid", "doc_id", F.col("n").alias("n_shingles"), "component_id", "keeper")
    alone = sets.where("set_key IS NULL").withColumn("component_id", F.col("doc_id")).withColumn("keeper", F.col("uid")).select(*out)
    return linked.join(of_set, "set_key").select(*out).unionByName(alone)


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of each row."""
    return _all_components(write_blocks(docs, id_col, text_col), shingle, percent).select("doc_id", "n_shingles", "component_id")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: one row of each component, with all its columns."""
    blocks = write_blocks(docs, id_col, text_col, carry=True)
    gone = _all_components(blocks, shingle, percent).where("uid <> keeper").select("uid")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block_id, payload in zip(batch["block_id"].to_pylist(), batch["payload"], strict=True):
                table = load(payload.as_buffer())
                yield pa.RecordBatch.from_pydict({"uid": _uids(block_id, len(table)), "text": table["text"].combine_chunks().cast(pa.string()), "row": table["row"].combine_chunks()})

    shape = StructType([StructField("uid", LongType()), StructField("text", StringType()), StructField("row", carried(docs, text_col))])
    rows = blocks.select("block_id", "payload").mapInArrow(unpack, shape)
    return as_before(docs, rows.join(gone, "uid", "left_anti"), text_col)
