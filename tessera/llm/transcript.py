"""Roles and turns of plain transcripts by a hidden Markov model, then canonical rendering.

States are the roles, each as a turn's first line or a later one. A line shows a symbol made of its
speaker marker (none, one of a known role, an unknown name) and its shape. Emissions and transitions are
counted, with smoothing, on transcripts whose roles are known. Viterbi runs in chunks of lines,
so a transcript of any length is spread: each chunk becomes a max-plus matrix from the state before it to
the state at its end, the matrices of a transcript (a few numbers a chunk) give the states at the chunk
ends, and each chunk is then solved between its two ends. The path equals that of one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import session
from tessera.llm.common import cut

ROLES = ("system", "user", "assistant")
MARKERS = {
    "system": "system|sys|instructions?|context",
    "user": "user|human|q|question|customer|client|prompt",
    "assistant": "assistant|ai|a|answer|bot|agent|response|model",
}


def _marked(words: str) -> str:
    """Lines with a marker of these words: before ':' or '>', bold, or in brackets that open and close. Plain words before
    '-' or ')' are text, and so is a letter in round brackets or before '|', as in lists and tables."""
    some = "|".join(w for w in words.split("|") if len(w) > 1)
    bold = rf"\*{{1,3}}[ ]?(?:{words})[ ]?(?:\*{{1,3}}[ ]?[:>]|[:>][ ]?\*{{1,3}})"
    held = rf"[*|]{{0,3}}(?:[\[<]\|?[ ]?(?:{words})[ ]?\|?[\]>]|\([ ]?(?:{some})[ ]?\))[*|]{{0,3}}(?:[ ]?:\*{{0,3}})?"
    return rf"(?i)^[ \t]*#{{0,6}}[ ]?(?:{bold}|{held}|(?:{words})[ ]?[:>]|\|?[ ]?(?:{some})[ ]?\|)[ \t]?"


SHAPES = 5
SYMBOLS = (len(ROLES) + 2) * SHAPES
STATES = 2 * len(ROLES)  # 2 r: first line of a turn of role r; 2 r + 1: a later one
CHUNK = 4096
#: Added to the counts: other markers than a role's own are rare, shapes are not.
MARK_PRIOR, SHAPE_PRIOR = 0.01, 1.0


def marker(line: Column) -> Column:
    """0 none, 1 + r a marker of role r, 4 an unknown name before a colon."""
    out = F.when(line.rlike(r"^[ \t]*\p{Lu}[\p{L}]{1,15}:[ \t]"), F.lit(len(ROLES) + 1)).otherwise(F.lit(0))
    for r, role in reversed(list(enumerate(ROLES))):
        out = F.when(line.rlike(_marked(MARKERS[role])), F.lit(r + 1)).otherwise(out)
    return out


def unmarked(line: Column) -> Column:
    """The line without its marker of a known role. An unknown name stays: no role stands for it."""
    return F.regexp_replace(line, _marked("|".join(MARKERS.values())), "")


def symbol(line: Column) -> Column:
    """What a line shows; a null line is an empty one."""
    line = F.coalesce(line, F.lit(""))
    shape = F.when(F.trim(line) == "", 0).when(line.rlike(r"\?[ \t\"')]*$"), 1).when(F.length(line) > 240, 2).when(F.length(line) > 80, 3).otherwise(4)
    return marker(line) * SHAPES + shape


@dataclass(frozen=True)
class Model:
    start: np.ndarray  # log, states
    step: np.ndarray  # log, states x states
    show: np.ndarray  # log, states x symbols


def fit(lines: DataFrame, turns: DataFrame) -> Model:
    """From lines (role, begin, symbol) and turns (id, turn, role) of known roles; other roles and nulls are
    left out. Only counts, at most states x symbols of them, reach the driver."""
    at = {r: i for i, r in enumerate(ROLES)}
    show = np.zeros((STATES, SYMBOLS))
    for r in lines.where(F.col("role").isin(*ROLES)).groupBy("role", "begin", "symbol").count().collect():
        show[2 * at[r.role] + (not r.begin), r.symbol] += r["count"]
    follow, first = np.ones((len(ROLES), len(ROLES))), np.ones(len(ROLES))
    known = turns.where(F.col("role").isin(*ROLES)).select("id", "turn", "role")
    after = known.select("id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next"))
    for r in known.join(after, ["id", "turn"]).groupBy("role", "next").count().collect():
        follow[at[r.role], at[r.next]] += r["count"]
    for r in known.where("turn = 0").groupBy("role").count().collect():
        first[at[r.role]] += r["count"]
    later = (show[1::2].sum(1) + 1) / (show[0::2].sum(1) + show[1::2].sum(1) + 2)  # chance that a line of a turn is followed by one more
    follow /= follow.sum(1, keepdims=True)
    with np.errstate(divide="ignore"):
        step, start = np.full((STATES, STATES), -np.inf), np.full(STATES, -np.inf)
        for r in range(len(ROLES)):
            for s in (2 * r, 2 * r + 1):
                step[s, 2 * r + 1] = np.log(later[r])
                step[s, 0::2] = np.log(1 - later[r]) + np.log(follow[r])
        start[0::2] = np.log(first / first.sum())
        # marker and shape count apart, so that a rare pair of both is not a rare event
        seen = show.reshape(STATES, -1, SHAPES)
        mark, shape = seen.sum(2) + MARK_PRIOR, seen.sum(1) + SHAPE_PRIOR
        pair = (mark / mark.sum(1, keepdims=True))[:, :, None] * (shape / shape.sum(1, keepdims=True))[:, None, :]
        return Model(start, step, np.log(pair.reshape(STATES, SYMBOLS)))


def transfer(model: Model, seen: np.ndarray) -> np.ndarray:
    """[s, t]: the best score of a path from state s before the symbols to state t at their end."""
    best = model.step + model.show[:, seen[0]][None, :]
    for o in seen[1:]:
        best = (best[:, :, None] + model.step[None, :, :]).max(1) + model.show[:, o][None, :]
    return best


def solve(model: Model, seen: np.ndarray, before: int = -1, end: int = -1) -> np.ndarray:
    """The best states of the symbols, after the state `before` (-1: at the start) and with the last one `end` (-1: free)."""
    score = (model.start if before < 0 else model.step[before]) + model.show[:, seen[0]]
    back = np.zeros((len(seen), STATES), np.int8)
    for i, o in enumerate(seen[1:], 1):
        ways = score[:, None] + model.step
        back[i] = ways.argmax(0)
        score = ways.max(0) + model.show[:, o]
    path = np.zeros(len(seen), np.int64)
    path[-1] = score.argmax() if end < 0 else end
    for i in range(len(seen) - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def parse(lines: DataFrame, model: Model, id: str, line: str, text: str, chunk: int = CHUNK) -> DataFrame:
    """(id column, turn, role, text) of every turn found in lines (id, line, text), line a number that orders them.

    chunk is the span of line numbers that one step takes. A null line text is an empty line; lines without
    an id or number are left out; of lines that repeat a number the order is that of their texts. A turn's
    text is its lines, the first one without its marker, joined by line ends. An empty table gives an empty result.
    """
    session.ship(lines.sparkSession)
    rows = lines.where(F.col(id).isNotNull() & F.col(line).isNotNull()).select(F.col(id).alias("id"), F.col(line).cast("long").alias("line"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("id", F.floor(F.col("line") / chunk).cast("long").alias("chunk"), F.struct("line", "text", symbol(F.col("text")).alias("o")).alias("x"))
    chunks = cut(rows.groupBy("id", "chunk").agg(F.array_sort(F.collect_list("x")).alias("x")).withColumn("o", F.transform("x", lambda x: x["o"])), "hmm-chunks")
    long = chunks.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("id")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = [transfer(model, np.array(o.as_py())).ravel().tolist() for o in b.column(2)]
            head = [(model.start + model.show[:, o[0].as_py()]).tolist() for o in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(m, pa.list_(pa.float64())), pa.array(head, pa.list_(pa.float64())), pa.array([len(o) for o in b.column(2)], pa.int64())], ["id", "chunk", "m", "head", "n"])

    kind = chunks.schema["id"].dataType.simpleString()
    scored = chunks.join(long, "id", "left_semi").select("id", "chunk", "o").mapInArrow(score, f"id {kind}, chunk long, m array<double>, head array<double>, n long")
    per = cut(scored.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("chunk", "m"))).alias("ms"), F.min(F.struct("chunk", "id")).alias("first")), "hmm-ends")
    firsts = chunks.join(per.select("id", F.col("first.chunk").alias("chunk")), ["id", "chunk"]).select("id", F.col("o").alias("fo"))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, number, before, last = [], [], [], []
            for i, ms, fo in zip(b.column(0), b.column(1), b.column(2), strict=True):
                ms, fo = ms.as_py(), np.array(fo.as_py())
                best = (model.start + model.show[:, fo[0]])  # scores over the first chunk
                for o in fo[1:]:
                    best = (best[:, None] + model.step).max(0) + model.show[:, o]
                back = []
                for m in ms[1:]:
                    ways = best[:, None] + np.array(m["m"]).reshape(STATES, STATES)
                    back.append(ways.argmax(0))
                    best = ways.max(0)
                state = int(best.argmax())
                states = [state]
                for w in reversed(back):
                    state = int(w[state])
                    states.append(state)
                states.reverse()
                ids += [i.as_py()] * len(ms)
                number += [m["chunk"] for m in ms]
                last += states
                before += [-1, *states[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(number, pa.int64()), pa.array(before, pa.int32()), pa.array(last, pa.int32())], ["id", "chunk", "before", "last"])

    known = per.select("id", "ms").join(firsts, "id").select("id", "ms", "fo").mapInArrow(ends, f"id {kind}, chunk long, before int, last int")
    work = chunks.join(known, ["id", "chunk"], "left").select("id", "chunk", F.coalesce("before", F.lit(-1)).alias("before"), F.coalesce("last", F.lit(-1)).alias("last"), "o", "x")

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The states of a chunk's lines and, of each, the number of turns that began in the chunk up to it."""
        for b in batches:
            paths = [solve(model, np.array(o.as_py()), p, e) for o, p, e in zip(b.column(4), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            begun = [np.cumsum(p % 2 == 0) for p in paths]
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(5), pa.array(paths, ints), pa.array(begun, ints), pa.array([int(x[-1]) for x in begun], pa.int64())], ["id", "chunk", "x", "path", "begun", "b"])

    solved = cut(work.mapInArrow(states, f"id {kind}, chunk long, x array<struct<line:bigint,text:string,o:int>>, path array<int>, begun array<int>, b long"), "hmm-paths")
    # turns are numbered over chunks: begins inside each chunk, then a running sum over a transcript's few chunks
    ahead = Window.partitionBy("id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = solved.select("id", "chunk", F.coalesce(F.sum("b").over(ahead), F.lit(0)).alias("base"))
    flat = solved.select("id", "chunk", F.explode(F.arrays_zip("x", "path", "begun")).alias("z")).join(before, ["id", "chunk"])
    first = F.col("z.path") % 2 == 0
    text_of = F.when(first, unmarked(F.col("z.x.text"))).otherwise(F.col("z.x.text"))
    flat = flat.select("id", (F.col("base") + F.col("z.begun") - 1).alias("turn"), F.col("z.path").alias("s"), F.struct("z.x.line", text_of.alias("text")).alias("x"))
    role = F.get(F.array(*[F.lit(r) for r in ROLES]), F.floor(F.min("s") / 2).cast("int"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]), "\n")
    return flat.groupBy("id", "turn").agg(role.alias("role"), body.alias("text")).withColumnRenamed("id", id)


def render(role: Column, text: Column) -> Column:
    """One turn in canonical form."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), F.trim(text), F.lit("\n<|end|>\n"))


STYLES = ("System: ,User: ,Assistant: ", "[SYSTEM] ,[HUMAN] ,[AI] ", "Context> ,Q> ,A> ", "**System**: ,**Customer**: ,**Agent**: ", "### Instruction: ,### Prompt: ,### Response: ")


def plain_lines(turns: DataFrame, silent: float = 0.2) -> DataFrame:
    """Plain transcript lines (id, line, text, role, begin, turn) of turns (id, turn, role, text): a style of
    markers a transcript, and a share of turns without one, both by hash. Line numbers are turn * 2^32 + place."""
    style = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(len(STYLES))).cast("int")
    marks = F.split(F.get(F.array(*[F.lit(s) for s in STYLES]), style), ",")
    mark = F.when(F.pmod(F.xxhash64("id", "turn", F.lit(2)), F.lit(1000)) < int(silent * 1000), "")
    for i, r in enumerate(ROLES):
        mark = mark.when(F.col("role") == r, F.get(marks, F.lit(i)))
    rows = turns.where("id is not null and turn is not null").select("id", "turn", "role", mark.otherwise("").alias("m"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "t"))
    return rows.select("id", (F.col("turn") * (1 << 32) + F.col("i")).alias("line"), F.when(F.col("i") == 0, F.concat("m", "t")).otherwise(F.col("t")).alias("text"), "role", (F.col("i") == 0).alias("begin"), "turn")
