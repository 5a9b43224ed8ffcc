"""Selections that cover what is asked for, from candidates that exclude one another."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallywright.sources.files import written

from .curriculum import attained

#: Cores taken since the pool was written last, from which on it is written again without what they exclude.
REWRITE = 2048


@dataclass
class State:
    """What is taken so far: bounded by the size of the selection, which is a setting."""

    size: int
    needs: dict[str, int]
    chosen: list[tuple] = field(default_factory=list)  # (id, cores, tags, stratum)
    cores: set = field(default_factory=set)
    got: dict[str, int] = field(default_factory=dict)
    held: dict[str, int] = field(default_factory=dict)

    def lacking(self) -> dict[str, int]:
        return {r: n - self.got.get(r, 0) for r, n in self.needs.items() if self.got.get(r, 0) < n}

    def take(self, row) -> None:
        self.chosen.append((row["id"], row["cores"], row["tags"], row["stratum"]))
        self.cores.update(row["cores"])
        for r in self.needs:
            self.got[r] = self.got.get(r, 0) + (set(r.split("&")) <= set(row["tags"]))
        self.held[row["stratum"]] = self.held.get(row["stratum"], 0) + 1


def has(requirement: str) -> Column:
    return reduce(lambda a, b: a & b, [F.array_contains("tags", t) for t in requirement.split("&")])


def tightest(lacks: dict[str, int], there: dict[str, int]) -> str | None:
    """The requirement with the least candidates for each unit that it lacks, by name if several; none if one can't be met any more."""
    if any(there[r] < n for r, n in lacks.items()):
        return None
    return min(lacks, key=lambda r: (there[r] / lacks[r], r))


def excluded(free: DataFrame, cores: set, most: int) -> list[tuple[set, str, int]] | None:
    """What goes with the cores: (those of them that it has, its kind, how many candidates), summed up; None if that is over `most` rows."""
    listed = free.sparkSession.createDataFrame([(c,) for c in cores], f"core {dict(free.dtypes)['cores'][6:-1]}")
    touched = free.select("id", "of", F.explode("cores").alias("core")).join(listed.hint("broadcast"), "core")  # the cores of at most `ahead` rows
    each = touched.groupBy("id", "of").agg(F.array_sort(F.collect_set("core")).alias("cores"))
    rows = each.groupBy("cores", "of").agg(F.count(F.lit(1)).alias("n")).limit(most + 1).collect()
    return None if len(rows) > most else [(set(r["cores"]), r["of"], r["n"]) for r in rows]


def firsts(free: DataFrame, by: str, there: dict[str, int], few: dict[str, int], wide: int) -> dict[str, list]:
    """The first rows by hash of each value of `by` in there (value: how many rows), few of it at most, perhaps less.

    Hashes are spread evenly, so the first ones are below a bound that the number of rows tells, and only those below it are sorted.
    What is below a bound comes before all else whatever the bound, so a list that it makes short is still the beginning of the order. wide: 1,
    or more after a round whose lists were of no use.
    """
    share = {x: wide * (2 * few[x] + 64) / n for x, n in there.items()}
    bounds = free.sparkSession.createDataFrame([(x, "g" if y >= 1 else f"{int(y * 2**60):015x}", few[x]) for x, y in share.items()], f"{by} string, below string, few int")
    near = free.join(bounds.hint("broadcast"), by).where(F.col("order") < F.col("below")).withColumn("k", F.row_number().over(W.partitionBy(by).orderBy("order"))).where("k <= few")
    lists: dict[str, list] = {x: [] for x in there}
    for r in near.orderBy(by, "k").collect():
        lists[r[by]].append(r)
    return lists


def covering(candidates: DataFrame, needs: dict[str, int], size: int, seed: int, ahead: int = 512, most: int = 50_000, ignored: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(chosen, shortages): at most size candidates of which no two share a core, the scarcest requirement served first.

    candidates: (id, cores, tags), both arrays; needs: the minimum for each requirement, one tag or several joined by &. While a
    requirement falls short, the one with the fewest candidates left for each unit that it lacks is served: of its
    candidates the one goes in that counts most (the sum of 1 / minimum over the requirements that fall short and that it has), and all that
    share a core with it are out. If fewer are left than one lacks, it can't be met, and nothing more is taken.
    When all are met, the strata (the sorted tags without those that begin with one of `ignored`) take turns, the least filled first.
    Ties go by seeded hash. Null cores and tags are none; identifiers should be unique. Shortages: (requirement, minimum, attained) of each that isn't met, and of the size.

    The pool stays distributed. Candidates are of a kind if they have the same of the requirements. A round counts each kind (one aggregate),
    brings the first candidates by hash of each that is wanted (`ahead` in all, or one of each) to the driver, and sums up what would go with their cores. So the
    driver knows all counts after each taking, and takes one after another, also when a requirement is met, until the list of a kind is used up. If the sums are over `most` rows, as with
    cores that very many share in different ways, or the kinds are, a round takes one. What the driver holds is bounded by size, ahead and most.
    """
    spark = candidates.sparkSession
    state, names = State(size, needs), list(needs)
    candidates = candidates.select("id", *[F.filter(F.coalesce(c, F.array().cast(t)), lambda x: x.isNotNull()).alias(c) for c, t in candidates.select("cores", "tags").dtypes])
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")), 256)
    tags = F.array_sort(F.filter("tags", lambda t: ~reduce(lambda a, b: a | b, [F.startswith(t, F.lit(p)) for p in ignored], F.lit(False))))
    kinds = dict(candidates.dtypes)
    kind = F.concat(F.lit(""), *[F.when(has(r), "1").otherwise("0") for r in names])
    whole = written(candidates.withColumns({"of": kind, "stratum": F.array_join(tags, "|")}))
    since: set = set()
    alone: list = []  # taken ones without a core, which nothing else takes out

    def pool() -> DataFrame:
        nonlocal whole, since, alone
        free = whole
        if since:
            gone = list(since)
            free = free.where(~F.exists("cores", lambda c: c.isin(gone)))
        if alone:
            free = free.where(~F.col("id").isin(alone))
        if len(since) + len(alone) > REWRITE:
            free = whole = written(free)
            since, alone = set(), []
        return free.withColumn("order", order)

    def take(row) -> None:
        state.take(row)
        since.update(row["cores"])
        if not row["cores"]:
            alone.append(row["id"])

    def worth(of: str) -> float:
        return sum(1.0 / needs[r] if of[names.index(r)] == "1" else 0.0 for r in state.lacking())

    wide, open_ = 1, True
    while open_ and len(state.chosen) < size and state.lacking():
        free, before = pool(), len(state.chosen)
        left = {r["of"]: r["n"] for r in free.groupBy("of").agg(F.count(F.lit(1)).alias("n")).limit(most + 1).collect()}
        if len(left) > most:
            row = scarcest(free, state)
            open_ = row is not None
            if row:
                take(row)
            continue
        lacks = state.lacking()
        wanted = {of: n for of, n in left.items() if worth(of)}
        few = {of: min(max(1, ahead // len(wanted)), 2 * sum(n for r, n in lacks.items() if of[names.index(r)] == "1") + 8) for of in wanted}
        lists = firsts(free, "of", wanted, few, wide) if wanted else {}
        gone = excluded(free, {c for x in lists.values() for r in x for c in r["cores"]}, most)
        while len(state.chosen) < size and (lacks := state.lacking()):
            first = tightest(lacks, {r: sum(n for of, n in left.items() if of[i] == "1") for i, r in enumerate(names)})
            if first is None:
                open_ = False
                break
            able = [of for of, n in left.items() if n and of[names.index(first)] == "1"]
            most_worth = max(map(worth, able))
            best = [of for of in able if worth(of) == most_worth]
            for of in best:
                lists[of] = [r for r in lists[of] if not state.cores & set(r["cores"])]
            if not all(lists[of] for of in best):
                break  # a row that isn't here may come first
            row = min((lists[of][0] for of in best), key=lambda r: r["order"])
            lists[row["of"]].remove(row)
            take(row)
            if gone is None:
                break
            mine, rest = set(row["cores"]), []
            for cores, of, n in gone:
                if cores & mine:
                    left[of] -= n
                else:
                    rest.append((cores, of, n))
            gone = rest
            if not mine:
                left[row["of"]] -= 1
        wide = 1 if len(state.chosen) > before else 64 * wide
    if not state.lacking():
        fill(state, pool, take)
    chosen = spark.createDataFrame(state.chosen, f"id {kinds['id']}, cores {kinds['cores']}, tags {kinds['tags']}, stratum string")
    asked = spark.createDataFrame(list(needs.items()), "requirement string, minimum long")
    short = attained(chosen, asked).where("not met").drop("met")
    all_ = chosen.agg(F.lit("size").alias("requirement"), F.lit(size).cast("long").alias("minimum"), F.count(F.lit(1)).alias("attained")).where("attained < minimum")
    return chosen, short.unionByName(all_)


def scarcest(free: DataFrame, state: State):
    """The next candidate of the scarcest requirement, by two scans; none if a requirement can't be met any more."""
    lacks = state.lacking()
    there = dict(zip(lacks, free.agg(*[F.count_if(has(r)) for r in lacks]).first(), strict=True))
    if not (first := tightest(lacks, there)):
        return None
    worth = reduce(lambda a, b: a + b, [F.when(has(r), 1.0 / state.needs[r]).otherwise(0.0) for r in lacks])
    return free.where(has(first)).orderBy(worth.desc(), "order").first()


def fill(state: State, pool, take) -> None:
    """Takes from the strata in turn until the size is reached or nothing is left: the least filled, then the first by name; in a stratum the first by hash.

    A round brings the first few candidates of the least filled strata; it ends where the next of a stratum isn't known.
    """
    wide = 1
    while len(state.chosen) < state.size:
        left = state.size - len(state.chosen)
        free = pool()
        n = free.groupBy("stratum").agg(F.count(F.lit(1)).alias("there"))
        held = free.sparkSession.createDataFrame(list(state.held.items()) or [("", 0)], "stratum string, held int")
        strata = n.join(held.hint("broadcast"), "stratum", "left").select("stratum", "there", F.coalesce("held", F.lit(0)).alias("held")).orderBy("held", "stratum").limit(left).collect()  # as many as are still wanted
        if not strata:
            return
        few = min(1000, 16 * (-(-left // len(strata)) + 1))
        there = {r["stratum"]: r["there"] for r in strata}
        lists = firsts(free, "stratum", there, dict.fromkeys(there, few), wide)
        cut = len(strata) == left  # there may be other strata, as filled as the last one or more
        last = (strata[-1]["held"], strata[-1]["stratum"])
        seen = dict.fromkeys(lists, 0)
        while len(state.chosen) < state.size:
            open_ = [s for s in lists if seen[s] < there[s]]
            if not open_:
                break
            s = min(open_, key=lambda s: (state.held.get(s, 0), s))
            if cut and (state.held.get(s, 0), s) > last or seen[s] == len(lists[s]):
                break  # another stratum, or a row that isn't here, may come first
            row = lists[s][seen[s]]
            seen[s] += 1
            if not state.cores & set(row["cores"]):
                take(row)
        wide = 1 if state.size - len(state.chosen) < left else 64 * wide
