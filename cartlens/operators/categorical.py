"""k-modes and column modes of columns with any number of values.

A column's distinct values are numbered in order (``dictionary``); a row is
its codes in lanes of ``bits`` bits, several to a bigint word.  Two rows differ in
as many columns as ``a ^ b`` has lanes that are not zero.  How often each value
occurs in a column is summed by value: a lane's low bit tells whether it holds the
value.  The mode of a column is its most frequent value, the lowest of equally
frequent ones; null is a value, lower than all others.

A dictionary is bounded by its parameter ``max_values`` per column, whatever
the number of rows; a column with more is an error.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.functions.bits import quoted
from cartlens.operators import kmodes as KM
from cartlens.operators import kmodes_rows as R
from cartlens.runtime import checkpoint_dir, delete_folder, scratch_folder

LANE_BITS = 63  # of a word; the sign bit stays free


@dataclass
class Codec:
    """Columns, their values in order, and the lanes their codes take."""

    columns: list[str]
    values: list[list]

    def __post_init__(self) -> None:
        most = max(map(len, self.values), default=1)
        self.bits = max(1, (most - 1).bit_length())
        self.lanes = LANE_BITS // self.bits
        self.words = [f"w{j}" for j in range(max(1, -(-len(self.columns) // self.lanes)))]
        self.most = most

    def at(self, i: int) -> tuple[str, int]:
        """Word and shift of a column's lane."""
        j, lane = divmod(i, self.lanes)
        return self.words[j], lane * self.bits

    def low(self, j: int) -> int:
        """The low bits of the lanes of word ``j`` that hold columns."""
        return sum(1 << lane * self.bits for lane in range(min(self.lanes, len(self.columns) - j * self.lanes)))

    # ------------------------------------------------- columns and codes
    def encoded(self) -> list[Column]:
        """The words of a row.  A value that is not in the dictionary is an error."""
        out = []
        for j, word in enumerate(self.words):
            total = F.lit(0).cast("long")
            for i in range(j * self.lanes, min((j + 1) * self.lanes, len(self.columns))):
                cell = F.col(self.columns[i])
                code = F.raise_error(F.lit(f"column {self.columns[i]}: a value is not in the dictionary")).cast("long")
                for c, v in reversed(list(enumerate(self.values[i]))):
                    code = F.when(cell.isNull() if v is None else cell == F.lit(v), F.lit(c).cast("long")).otherwise(code)
                total = total.bitwiseOR(F.shiftleft(code, self.at(i)[1]))
            out.append(total.alias(word))
        return out

    def code(self, i: int, words: Sequence[str] | None = None) -> str:
        """SQL text: the code of column ``i``."""
        word, shift = self.at(i)
        word = word if words is None else words[self.words.index(word)]
        return f"(shiftright({quoted(word)}, {shift}) & {(1 << self.bits) - 1})"

    def decoded(self, types: dict[str, str]) -> list[Column]:
        """The values back from the words."""
        out = []
        for i, name in enumerate(self.columns):
            values = F.array(*[F.lit(v).cast(types[name]) for v in self.values[i]])
            out.append(F.get(values, F.expr(f"cast({self.code(i)} as int)")).alias(name))
        return out

    # ------------------------------------------------- SQL of the kernels
    def _unequal(self, a: str, b: str, j: int) -> str:
        """The low bits of the lanes that differ."""
        x = f"({a} ^ {b})"
        return "((" + " | ".join([x, *[f"shiftrightunsigned({x}, {s})" for s in range(1, self.bits)]]) + f") & {self.low(j)}L)"

    def sql_distance(self, row: str, words: Sequence[str], modes: str, at: int) -> str:
        return " + ".join(f"bit_count({self._unequal(f'{row}.{quoted(w)}', f'{modes}[{at + j}]', j)})" for j, w in enumerate(words))

    def sql_mode(self, rows: str, words: Sequence[str], planes: int) -> str:
        """Array of the words of the rows' modes: vertical counts for each value,
        then the greatest, value by value; code 0 everywhere without rows."""
        slots, added = [], []
        for j, w in enumerate(words):
            for v in range(self.most):
                at = len(slots)
                hit = f"(~{self._unequal(f'r.{quoted(w)}', f'{self.low(j) * v}L', j)} & {self.low(j)}L)"
                for p in range(planes):
                    added.append(f"a[{at + p}] ^ (" + " & ".join([hit, *[f"a[{at + q}]" for q in range(p)]]) + ")")
                slots += ["0L"] * planes
        counted = f"aggregate({rows}, array({', '.join(slots)}), (a, r) -> array({', '.join(added)}))"
        out = []
        for j in range(len(words)):
            first = j * self.most * planes
            # best: its planes, then the code of every lane
            body = f"b{self.most - 1}[{planes}]"
            for v in range(self.most - 1, 0, -1):
                own, old = [f"n[{first + v * planes + p}]" for p in range(planes)], [f"b{v - 1}[{p}]" for p in range(planes)]
                greater = "(" + " | ".join("(" + " & ".join(
                    [own[p], f"~{old[p]}", *[f"~({own[q]} ^ {old[q]})" for q in range(p + 1, planes)]]) + ")" for p in range(planes)) + ")"
                taken = [f"(g & {own[p]}) | (~g & {old[p]})" for p in range(planes)]
                filled = "(" + " | ".join(f"shiftleft(g, {s})" for s in range(self.bits)) + ")"
                code = f"(({filled} & {self.low(j) * v}L) | (~{filled} & b{v - 1}[{planes}]))"
                step = R._let(greater, "g", f"array({', '.join([*taken, code])})")
                body = R._let(step, f"b{v}", body)
            out.append(R._let(f"array({', '.join([*[f'n[{first + p}]' for p in range(planes)], '0L'])})", "b0", body))
        return R._let(counted, "n", f"array({', '.join(out)})")

    # ------------------------------------------------- what density_seeds asks
    def sums(self, words: Sequence[str]) -> list[Column]:
        return [F.expr(f"coalesce(sum(cast({self.code(i, words)} = {v} as bigint)), 0) as _o{i}_{v}")
                for i in range(len(self.columns)) for v in range(len(self.values[i]))]

    def agreement(self, words: Sequence[str]) -> Column:
        terms = [f"case {self.code(i, words)} " + " ".join(f"when {v} then _o{i}_{v}" for v in range(len(self.values[i]))) + " end"
                 for i in range(len(self.columns))]
        return F.expr(" + ".join(terms) if terms else "0L")

    def distance(self, words: Sequence[str], other: Sequence[Column]) -> Column:
        total = F.lit(0)
        for j, (w, o) in enumerate(zip(words, other)):
            x = F.col(w).bitwiseXOR(o)
            folded = x
            for s in range(1, self.bits):
                folded = folded.bitwiseOR(F.shiftrightunsigned(x, s))
            total = total + F.bit_count(folded.bitwiseAND(F.lit(self.low(j)).cast("long")))
        return total.cast("int")


def dictionary(rows: DataFrame, columns: Sequence[str], max_values: int = 64) -> Codec:
    """The values of every column, in order (null first).  Each task passes on
    distinct values only; at most ``max_values`` a column reach the driver."""
    columns = list(columns)
    kinds: dict[str, list[int]] = {}
    for i, c in enumerate(columns):
        kinds.setdefault(rows.schema[c].dataType.simpleString(), []).append(i)
    values: list[list] = [[] for _ in columns]
    for some in kinds.values():  # one job for the columns of a type
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(columns[i]).alias("v")) for i in some])).alias("c")
        order = Window.partitionBy("i").orderBy(F.asc_nulls_first("v"))
        seen = rows.select(cells).select("c.i", "c.v").distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= max_values + 1)
        for row in seen.orderBy("i", "r").collect():
            values[row["i"]].append(row["v"])
    for c, v in zip(columns, values):
        if len(v) > max_values:
            raise ValueError(f"column {c} has more than {max_values} values")
    return Codec(columns, values)


def encode(rows: DataFrame, codec: Codec, keep: Sequence[str]) -> DataFrame:
    """``(keep..., w0, ...)``."""
    return rows.select(*keep, *codec.encoded())


def group_modes(rows: DataFrame, group: str, codec: Codec) -> DataFrame:
    """Column-wise mode of each group (A11) of encoded rows: ``(group, w...)``."""
    agg = rows.groupBy(group).agg(*codec.sums(codec.words))
    return agg.select(group, *_mode_words(codec))


def _mode_words(codec: Codec) -> list[Column]:
    """Words of the modes from the sums ``_o{i}_{v}``: the greatest, the lowest value first."""
    out = []
    for j, word in enumerate(codec.words):
        terms = ["0L"]
        for i in range(j * codec.lanes, min((j + 1) * codec.lanes, len(codec.columns))):
            n = len(codec.values[i])
            most = f"greatest({', '.join(f'_o{i}_{v}' for v in range(n))})" if n > 1 else f"_o{i}_0"
            code = "case " + " ".join(f"when _o{i}_{v} = {most} then {v}L" for v in range(n)) + " end"
            terms.append(f"shiftleft({code}, {codec.at(i)[1]})")
        out.append(F.expr(" | ".join(terms) + f" as {word}"))
    return out


def fit(rows: DataFrame, group: str, order: Sequence[Column], codec: Codec, k: int = 2, max_iter: int | str = 50,
        payload: Sequence[str] = (), initial: DataFrame | None = None, in_row: int = R.IN_ROW) -> KM.KModesResult:
    """k-modes of every group of encoded rows (C8 beyond 0/1 cells): as
    ``kmodes.fit``, with mismatching columns as distance and the most frequent value as mode.

    Without ``initial`` modes the seeds are those of ``kmodes.density_seeds`` for any
    ``k`` (the rule of ``kmodes.seeds`` needs two values).  Groups of at most
    ``in_row`` rows are one row each; larger ones take a job per round."""
    words = codec.words
    order = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    rows = rows.select(group, *payload, *words, *order).where(F.col(group).isNotNull())
    order = [F.col(f"_o{i}") for i in range(len(order))]
    checkpoint_dir(rows.sparkSession)
    rows = rows.checkpoint()  # read for sizes, seeds and rounds
    if initial is None:
        initial = KM.density_seeds(rows, group, order, words, 0, k, payload, codec).withColumnRenamed("seed", KM.CLUSTER)
    starts = KM._checked(initial, group, words, k)
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_gn"))
    least, most = sizes.agg(F.coalesce(F.min("_gn"), F.lit(0)), F.coalesce(F.max("_gn"), F.lit(0))).first()
    # at most (all rows / in_row) groups are large
    large, parts = sizes.where(F.col("_gn") > in_row).select(group), []
    if least <= in_row:
        small = rows.join(large, group, "left_anti") if most > in_row else rows
        groups = R.gathered(small, group, order, words, payload).join(starts, group)
        first = f"flatten(transform(_modes, m -> array({', '.join('m.' + quoted(w) for w in words)})))"
        done = R.fitted(groups, words, k, "size(_rows)" if max_iter == "rows" else str(int(max_iter)), R.planes_for(min(most, in_row)),
                        first, codec.sql_distance, codec.sql_mode).checkpoint()
        parts.append(KM.KModesResult(R.assignments_of(done, group, words, payload, KM.CLUSTER, codec.sql_distance),
                                     R.modes_of(done, group, words, k, KM.CLUSTER), done.agg(F.max("_fit.rounds")).first()[0] or 0))
    if most > in_row:
        some = rows.join(large, group, "left_semi") if least <= in_row else rows
        parts.append(_fit_large(some, group, order, codec, k, max_iter, payload, starts.join(large, group, "left_semi")))
    if len(parts) == 1:
        return parts[0]
    return KM.KModesResult(parts[0].assignments.unionByName(parts[1].assignments), parts[0].modes.unionByName(parts[1].modes),
                           max(p.rounds for p in parts))


def _fit_large(rows: DataFrame, group: str, order: Sequence[Column], codec: Codec, k: int, max_iter: int | str, payload: Sequence[str],
               starts: DataFrame) -> KM.KModesResult:
    """Large groups: rows stay where they are, every round joins one small row
    per group and moves the sums of a cluster; finished groups go to a table of their own."""
    words, spark = codec.words, rows.sparkSession
    n, folder = len(words), scratch_folder(spark, "coded")
    cells = [(c, j) for c in range(k) for j in range(n)]
    now, used = [f"_m{c}_{j}" for c, j in cells], [f"_u{c}_{j}" for c, j in cells]

    def nearest(names: Sequence[str]) -> Column:
        away = [codec.distance(words, [F.col(x) for x in names[c * n:(c + 1) * n]]) for c in range(k)]
        best, out = (F.least(*away) if k > 1 else away[0]), None
        for c, d in enumerate(away):
            out = F.when(d == best, F.lit(c)) if out is None else out.when(d == best, F.lit(c))
        return out

    def written(df: DataFrame, name: str, mode: str = "errorifexists") -> DataFrame:
        df.write.mode(mode).parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    limit = F.col("_rows") if max_iter == "rows" else F.lit(int(max_iter))
    state = written(starts.select(group, *[F.col("_modes")[c][w].alias(f"_m{c}_{j}") for c in range(k) for j, w in enumerate(words)],
                                  *[F.lit(None).cast("long").alias(u) for u in used], F.lit(0).alias("_rounds")), "state-0")
    step = 0
    while True:
        step += 1
        # the state's few rows are joined to the rows; only sums of (group, cluster) move
        assigned = rows.select(group, *words).join(state, group).withColumn(KM.CLUSTER, nearest(now)) \
            .withColumn("_moved", F.coalesce((nearest(used) != F.col(KM.CLUSTER)).cast("int"), F.lit(1)))
        sums = assigned.groupBy(group, KM.CLUSTER).agg(F.count(F.lit(1)).alias("_n"), F.max("_moved").alias("_any"), *codec.sums(words))
        modes = sums.select(group, KM.CLUSTER, "_n", "_any", *_mode_words(codec))
        new = [F.coalesce(F.max(F.when(F.col(KM.CLUSTER) == c, F.col(words[j]))), F.lit(0).cast("long")).alias(f"_n{c}_{j}") for c, j in cells]
        per = modes.groupBy(group).agg(F.max("_any").alias("_any"), F.sum("_n").alias("_rows"), *new).join(state, group)
        per = per.select(group, *[F.col(f"_n{c}_{j}").alias(f"_m{c}_{j}") for c, j in cells], *[F.col(m).alias(u) for m, u in zip(now, used)],
                         (F.col("_rounds") + 1).alias("_rounds"),
                         ((F.col("_rounds") + 1 >= limit) | ((F.col("_any") == 0) & (F.col("_rounds") >= 1))).alias("_done"))
        per = written(per, f"ahead-{step}")
        ended = written(per.where("_done").drop("_done"), "finished", "append")
        state = written(per.where("not _done").drop("_done"), f"state-{step}")
        delete_folder(spark, f"{folder}/state-{step - 1}")
        if state.isEmpty():
            break
        delete_folder(spark, f"{folder}/ahead-{step}")
    cluster = nearest(used)
    away = [codec.distance(words, [F.col(x) for x in now[c * n:(c + 1) * n]]) for c in range(k)]
    own = F.coalesce(*[F.when(F.col(KM.CLUSTER) == c, d) for c, d in enumerate(away)])
    out = rows.join(ended, group).withColumn(KM.CLUSTER, cluster).withColumn("distance", own)
    key = F.struct(*[c.alias(f"_k{i}") for i, c in enumerate(order)]).alias("_ord")
    assignments = out.select(group, *payload, KM.CLUSTER, "distance", F.col("_rounds").alias("rounds"), key, *words)
    modes = ended.select(group, F.explode(F.array(*[F.struct(F.lit(c).alias(KM.CLUSTER), *[
        F.col(f"_m{c}_{j}").alias(words[j]) for j in range(n)]) for c in range(k)])).alias("_s")).select(group, "_s.*")
    return KM.KModesResult(assignments, modes, ended.agg(F.max("_rounds")).first()[0] or 0)
