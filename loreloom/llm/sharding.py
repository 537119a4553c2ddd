"""Sharding by balanced label propagation, in DataFrame operations only.

Rows with an equal link are neighbours. Linked rows start in the shard of a hash; in every round each one looks at the shards of
its neighbours and asks to move to the one that holds most of them: in even rounds among those with room, in odd ones among all.
Quotas of the receiving shards, small groups first, decide which share of the asking rows moves; rows that leave a shard in a round
make room in it in the same round. Every move saves a cut edge, so rounds come to an end: when neither kind of round moves a row. Rows without neighbours cut no edge anywhere, so
they come last and fill every shard to the same number of rows, at most one apart.

Votes are counted per link and shard before they meet the rows, so a link on a third of all rows has at most one vote row per
shard. Only tables of shards x classes of group sizes come to the driver. Numbering inside a shard is done in blocks.

Defined results: a null link has no neighbours; repeated rows are placed each; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreloom.llm.common import crc32_text, utf8_bytes
from loreloom.session import cut_lineage

SHARDS = 16
BLOCK = 4_096  # rows numbered together, at most about
BLOCKS = 2_048  # blocks of all shards together, at least


def _share(asking: list, room: list[int]) -> dict[tuple[int, int], float]:
    """The share of the rows asking for a shard, by (shard, class of group size), that may move; small groups first."""
    left, share = list(room), {}
    for target, kind, n in sorted(asking):
        moved = max(0, min(n, left[target]))
        share[target, kind] = moved / n
        left[target] -= moved
    return share


def _swaps(flows: dict[tuple[int, int, int], int], room: list[int]) -> dict[tuple[int, int], float]:
    """The share of the rows asking for a shard, by (shard, class), where those who leave make room; flows: by (from, to, class)."""
    wishes: dict[tuple[int, int], int] = {}
    for (_, target, kind), n in flows.items():
        wishes[target, kind] = wishes.get((target, kind), 0) + n
    asking, share = [(t, k, n) for (t, k), n in wishes.items()], dict.fromkeys(wishes, 1.0)
    while True:
        left = list(room)
        for (source, target, kind), n in flows.items():
            left[source] += n * share[target, kind]
        # Fewer admitted are fewer who leave, so shares only fall; less than half a row does not count.
        fewer = {at: p if p * wishes[at] >= 0.5 else 0.0 for at, p in _share(asking, left).items()}
        if all(abs(share[at] - p) * wishes[at] < 0.5 for at, p in fewer.items()):
            return fewer
        share = fewer


def propagate(linked: DataFrame, rows: int, shards: int) -> DataFrame:
    """linked: (__link, __h, __class, ...) rows with neighbours; adds __shard."""
    state = linked.withColumn("__shard", F.pmod("__h", F.lit(shards)).cast("int"))
    quota = rows // shards
    sizes = [0] * shards
    for r in cut_lineage(state.groupBy("__shard").agg(F.count("*").alias("n"))).collect():
        sizes[r["__shard"]] = r.n
    round_ = still = 0
    while still < 2:
        votes = state.groupBy("__link", "__shard").agg(F.count("*").alias("n"))
        tie = F.xxhash64("__link", "__shard")
        ballots = cut_lineage(votes.groupBy("__link").agg(F.collect_list(F.struct("n", tie.alias("t"), F.col("__shard").alias("s"))).alias("__votes")))
        full = F.array(*[F.lit(round_ % 2 == 0 and sizes[s] >= quota) for s in range(shards)])
        here = lambda v: v["s"] == F.col("__shard")
        mine = F.filter("__votes", here)[0]
        open_ = F.filter("__votes", lambda v: here(v) | ~F.element_at(full, v["s"] + 1))
        best = F.array_max(F.filter(open_, lambda v: F.struct(v["n"], v["t"]) >= F.struct(mine["n"], mine["t"])))
        # A merge join, so that Spark splits the rows of a text that a third of all rows share.
        asked = cut_lineage(state.join(ballots.hint("merge"), "__link").withColumn("__target", best["s"]).drop("__votes"))
        flows = asked.groupBy("__shard", "__target", "__class").agg(F.count("*").alias("n")).collect()  # at most shards ** 2 x classes
        share = _swaps({(r["__shard"], r["__target"], r["__class"]): r.n for r in flows if r["__shard"] != r["__target"]}, [quota - s for s in sizes])
        round_, still = round_ + 1, still + 1
        if not any(share.values()):
            continue
        allowed = F.create_map(*[F.lit(x) for (t, k), p in share.items() for x in (t * 64 + k, float(p))])
        dice = F.pmod(F.xxhash64("__h", "__link", F.lit(round_)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        goes = (F.col("__target") != F.col("__shard")) & (dice < F.coalesce(F.element_at(allowed, F.col("__target") * 64 + F.col("__class")), F.lit(0.0)))
        state = cut_lineage(asked.withColumn("__moved", goes).withColumn("__shard", F.when(goes, F.col("__target")).otherwise(F.col("__shard"))).drop("__target"))
        sizes = [0] * shards
        for r in state.groupBy("__shard").agg(F.count("*").alias("n"), F.count_if("__moved").alias("moved")).collect():
            sizes[r["__shard"]] = r.n
            still = 0 if r["moved"] else still
        state = state.drop("__moved")
    return state


def shard(rows: DataFrame, doc_id: Column, link: Column, *, shards: int = SHARDS) -> DataFrame:
    """*rows* with __shard (0 to shards - 1) and __slot (gapless from 0 in each shard); counts differ by one at most.

    *rows* should be slim: they are written once for every round.
    """
    rows = cut_lineage(rows.withColumn("__link", link).withColumn("__h", F.xxhash64(F.lit(5), doc_id)))
    total = rows.count()
    groups = rows.where("__link IS NOT NULL").groupBy("__link").agg(F.count("*").alias("__n")).where("__n > 1")
    groups = cut_lineage(groups.select("__link", F.floor(F.log2("__n")).cast("int").alias("__class")))
    linked = propagate(rows.join(groups, "__link"), total, shards)
    alone = rows.join(groups.select("__link"), "__link", "left_anti")
    piles = cut_lineage(linked.drop("__class").unionByName(alone.withColumn("__shard", F.lit(shards)).select(*linked.drop("__class").columns)))
    blocks = max(-(-total // BLOCK), -(-BLOCKS // shards))
    piles = piles.withColumn("__block", F.pmod(F.xxhash64(F.lit(6), "__h", "__link"), F.lit(blocks)))
    counts = cut_lineage(piles.groupBy("__shard", "__block").agg(F.count("*").alias("__n")))
    ahead = Window.partitionBy("__shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut_lineage(counts.select("__shard", "__block", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__start")))
    inside = Window.partitionBy("__shard", "__block").orderBy("__h", doc_id)
    ranked = piles.withColumn("__r", F.row_number().over(inside) - 1).join(starts, ["__shard", "__block"])
    ranked = ranked.withColumn("__r", F.col("__r") + F.col("__start"))
    held = [0] * (shards + 1)
    for r in counts.groupBy("__shard").agg(F.sum("__n").alias("n")).collect():
        held[r["__shard"]] = r.n
    # Free rows: those without neighbours, then what a shard holds beyond its quota. They fill the shards in order.
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    kept = [min(held[s], quota[s]) for s in range(shards)]
    over = [held[s] - kept[s] for s in range(shards)]
    first_free = [held[shards] + sum(over[:s]) - quota[s] for s in range(shards)] + [0]
    listed = lambda xs: F.array(*[F.lit(int(x)) for x in xs])
    at = lambda xs, i: F.element_at(listed(xs), i + 1)
    stays = (F.col("__shard") < shards) & (F.col("__r") < at([*quota, 0], F.col("__shard")))
    ranked = ranked.withColumn("__free", F.when(~stays, F.col("__r") + at(first_free, F.col("__shard"))))
    gaps = [sum(quota[:s]) - sum(kept[:s]) for s in range(shards)]  # free rows that the shards before take
    filled = F.size(F.filter(listed(gaps), lambda g: g <= F.col("__free"))) - 1
    ranked = ranked.withColumn("__to", F.when(stays, F.col("__shard")).otherwise(filled))
    slot = F.when(stays, F.col("__r")).otherwise(F.col("__free") - at(gaps, F.col("__to")) + at(kept, F.col("__to")))
    return ranked.withColumn("__slot", slot.cast("long")).withColumn("__shard", F.col("__to").cast("int")).drop("__block", "__r", "__start", "__free", "__to", "__h")


def shard_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, shards: int = SHARDS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard; documents with equal texts are linked."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), (utf8_bytes(text) + 1).alias("size"), crc32_text(text).alias("text_crc32"),
                       F.xxhash64(F.col(text).isNull(), F.coalesce(F.col(text), F.lit(""))).alias("key"))
    placed = shard(slim, F.col("doc_id"), F.col("key"), shards=shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("__shard").alias("shard"), F.col("__slot").alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"))
