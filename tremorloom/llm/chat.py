"""Chat formatting: a hidden Markov model recovers the roles of transcript lines, then turns are rendered canonically.

A transcript is the lines of a conversation in order: of each row, its text's lines. A line shows a speaker marker (a word such
as User or Assistant and a colon, or the role that its row declares), or none, and a class of line features: whether it opens
a row, its length, a question, a list or code. States are roles. Start, transition and feature probabilities are counted, with
smoothing, over all rows that declare a role; markers are believed to all but MARKER_ERROR. Viterbi finds the likeliest roles.

Conversations are dealt by range of (conversation, turn), so one of any length is spread over many tasks. Each task multiplies
its stretch into one matrix of best scores between its first and last role; the matrices of a conversation, one a task at most,
are chained; then each task runs Viterbi between the roles fixed at its ends. The result is that of one pass.

Rows are ordered by turn, nulls last, then role and text; rows without a conversation form one together. Null and empty texts are
one blank line. A declared role that is not one of ROLES counts as no marker. Repeated rows stay. Other columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorloom.llm.common import cut, partitions

#: States.
ROLES = ("system", "user", "assistant", "tool")
#: The words that mark a speaker, by role.
MARKERS = {"system": "system", "user": "user", "human": "user", "prompter": "user", "question": "user", "q": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant", "answer": "assistant", "a": "assistant", "gpt": "assistant", "model": "assistant", "tool": "tool", "function": "tool"}
MARKER_ERROR = 1e-8
ALPHA = 1.0
LENGTHS = (20, 60, 140, 300, 700, 1500)
_MARK = re.compile(r"^\s*(?:[<\[*#]{0,3}\s*)([A-Za-z]+)\s*[>\]*]{0,3}\s*:\s*")
_LIST = re.compile(r"^\s*(?:[-*+] |\d+[.)] |```|\||    )")
CLASSES = 2 * (len(LENGTHS) + 1) * 3


def marker_of(line: str) -> tuple[str | None, str]:
    """The role that a line's own marker names and the line without it."""
    if (m := _MARK.match(line)) and (role := MARKERS.get(m[1].lower())):
        return role, line[m.end() :]
    return None, line


def class_of(line: str, opens: bool) -> int:
    kind = 2 if _LIST.match(line) else 1 if line.rstrip().endswith("?") else 0
    return (int(opens) * (len(LENGTHS) + 1) + int(np.searchsorted(LENGTHS, len(line)))) * 3 + kind


def lines_of(role: str | None, text: str | None) -> list[tuple[int, int, str]]:
    """(marked role or -1, feature class, bare line) of a row; the row's role marks its first line where the line does not."""
    out = []
    for i, line in enumerate((text or "").split("\n")):
        said, bare = marker_of(line)
        said = said or ((role or "").strip().lower() if i == 0 else None)
        out.append((ROLES.index(said) if said in ROLES else -1, class_of(bare, i == 0), bare))
    return out


class Model:
    """Log probabilities: start by role, transitions by role pair (rows or lines of one row), features by role and class."""

    def __init__(self, start: np.ndarray, across: np.ndarray, within: np.ndarray, shown: np.ndarray) -> None:
        self.start, self.across, self.within, self.shown = start, across, within, shown
        k = len(ROLES)
        self.marked = np.log(np.full((k, k), MARKER_ERROR / (k - 1)) + np.eye(k) * (1 - MARKER_ERROR - MARKER_ERROR / (k - 1)))

    def seen(self, mark: int, kind: int) -> np.ndarray:
        return self.shown[:, kind] + (self.marked[:, mark] if mark >= 0 else 0.0)

    def step(self, opens: bool) -> np.ndarray:
        return self.across if opens else self.within


def dealt(rows: DataFrame) -> DataFrame:
    """Rows in order, by range; checkpointed, so that both passes see the same stretches."""
    order = [F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.md5("text").asc_nulls_last()]
    keyed = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ranged = keyed.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    return cut(ranged.withColumn("part", F.spark_partition_id()))


def fit(placed: DataFrame) -> Model:
    """Counts over all rows that declare a role: their first line, their other lines, and the declared role before."""
    k = len(ROLES)
    fields = pa.schema([("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int, int], int] = {}
        conversation, before = object(), -1
        for batch in batches:
            for conv, turn, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text")), strict=True):
                now = ROLES.index(role.strip().lower()) if role and role.strip().lower() in ROLES else -1
                if conv != conversation:
                    before = -1
                    if now >= 0 and turn == 0:
                        counts["start", now, 0] = counts.get(("start", now, 0), 0) + 1
                conversation = conv
                if now >= 0:
                    if before >= 0:
                        counts["across", before, now] = counts.get(("across", before, now), 0) + 1
                    for _, kind, _ in lines_of(role, text):
                        counts["shown", now, kind] = counts.get(("shown", now, kind), 0) + 1
                before = now
        rows = [(*key, n) for key, n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], schema=fields)

    counted = placed.select("conv_id", "turn", "role", "text").mapInArrow(run, "kind string, a int, b int, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()  # a few hundred rows
    start, across, shown = np.full(k, ALPHA), np.full((k, k), ALPHA), np.full((k, CLASSES), ALPHA)
    for r in counted:
        if r["kind"] == "start":
            start[r["a"]] += r["n"]
        elif r["kind"] == "across":
            across[r["a"], r["b"]] += r["n"]
        else:
            shown[r["a"], r["b"]] += r["n"]
    within = np.full((k, k), 0.01) + np.eye(k) * (1 - 0.01 * k)
    return Model(np.log(start / start.sum()), np.log(across / across.sum(axis=1, keepdims=True)), np.log(within), np.log(shown / shown.sum(axis=1, keepdims=True)))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in batch.schema.names), strict=True)


def products(stretches: DataFrame, model: Model) -> DataFrame:
    """(conv_id, part, best): for each stretch (conv_id, part, role, text, first) the best scores, flattened.

    Row by row from each role before its first line, column by column to each role of its last. The first stretch of a
    conversation has no role before it; all its rows are the scores from the start.
    """
    k = len(ROLES)
    fields = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("best", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int32()), pa.array([best.ravel()], pa.list_(pa.float64()))], schema=fields)

        for conv, part, role, text, first in _rows(batches):
            fresh = now != (conv, part)
            if fresh:
                if now is not None:
                    yield done()
                now, best = (conv, part), np.where(np.eye(k) > 0, 0.0, -np.inf)
            for i, (mark, kind, _) in enumerate(lines_of(role, text)):
                if fresh and first and i == 0:
                    best = np.tile(model.start, (k, 1))
                else:
                    best = (best[:, :, None] + model.step(i == 0)[None]).max(axis=1)
                best = best + model.seen(mark, kind)[None]
        if now is not None:
            yield done()

    return stretches.select("conv_id", "part", "role", "text", "first").mapInArrow(run, "conv_id long, part int, best array<double>")


def boundaries(matrices: DataFrame) -> DataFrame:
    """(conv_id, part, enter, leave): the role before each stretch, -1 at a conversation's start, and the role of its last line.

    Only conversations that lie in several tasks come here; each has a row a task at most.
    """
    k = len(ROLES)

    def chain(pdf):
        pdf = pdf.sort_values("part")
        blocks = [np.array(b).reshape(k, k) for b in pdf["best"]]
        score, back = None, []
        for b in blocks:
            if score is None:
                score = b[0]
                back.append(np.zeros(k, int))
            else:
                total = score[:, None] + b
                back.append(total.argmax(axis=0))
                score = total.max(axis=0)
        leave = [int(score.argmax())]
        for p in back[:0:-1]:
            leave.append(int(p[leave[-1]]))
        leave = leave[::-1]
        return pdf[["conv_id", "part"]].assign(enter=[-1, *leave[:-1]], leave=leave)

    return matrices.groupBy("conv_id").applyInPandas(chain, "conv_id long, part int, enter int, leave int")


def recovered(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, line, role, declared, rendered) of every line: its role by Viterbi and its piece of the canonical form.

    A line that starts a turn is rendered with the turn's header, and the one that ends a turn with its end mark, so the
    pieces of a conversation, in order and joined by line breaks, are the transcript in canonical form.
    """
    placed = dealt(rows)
    model = fit(placed)
    spread = placed.select("conv_id", "part").distinct().groupBy(F.col("conv_id").alias("c")).agg(F.min("part").alias("low"), F.max("part").alias("high"))
    split = cut(spread.where("low < high"))  # at most one conversation for each border between tasks
    marked = placed.withColumns({"enter": F.lit(-1), "leave": F.lit(-1)})
    if not split.isEmpty():
        parts = placed.join(F.broadcast(split), F.col("conv_id").eqNullSafe(F.col("c"))).withColumn("first", F.col("part") == F.col("low"))
        ends = cut(boundaries(products(parts, model))).select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "enter", "leave")
        known = placed.join(F.broadcast(ends), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
        marked = known.withColumns({"enter": F.coalesce("enter", F.lit(-1)), "leave": F.coalesce("leave", F.lit(-1))})
    return marked.select("conv_id", "turn", "role", "text", "enter", "leave").mapInArrow(_render(model), "conv_id long, turn long, line int, role string, declared string, rendered string")


def viterbi(model: Model, marks: list[int], kinds: list[int], opens: list[bool], enter: int = -1, leave: int = -1) -> list[int]:
    """The likeliest roles of consecutive lines, given the role before the first and that of the last where they are known."""
    back = np.zeros((len(marks), len(ROLES)), np.int8)
    score = None
    for i, (mark, kind, first) in enumerate(zip(marks, kinds, opens, strict=True)):
        if score is None:
            score = model.start if enter < 0 else model.step(first)[enter]
        else:
            total = score[:, None] + model.step(first)
            back[i] = total.argmax(axis=0)
            score = total.max(axis=0)
        score = score + model.seen(mark, kind)
    out = [leave if leave >= 0 else int(score.argmax())]
    for i in range(len(marks) - 1, 0, -1):
        out.append(int(back[i, out[-1]]))
    return out[::-1]


def _render(model: Model):
    fields = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("line", pa.int32()), ("role", pa.string()), ("declared", pa.string()), ("rendered", pa.string())])

    def stretch(rows: list[tuple]) -> pa.RecordBatch:
        lines = [(r, i, *x) for r in rows for i, x in enumerate(lines_of(r[2], r[3]))]
        roles = viterbi(model, [x[2] for x in lines], [x[3] for x in lines], [x[1] == 0 for x in lines], rows[0][4], rows[0][5])
        columns: list[list] = [[] for _ in fields]
        for n, ((row, i, _, _, bare), role) in enumerate(zip(lines, roles, strict=True)):
            starts = i == 0 or roles[n - 1] != role
            ends = n + 1 == len(lines) or lines[n + 1][1] == 0 or roles[n + 1] != role
            piece = f"<|{ROLES[role]}|>\n" * starts + bare.rstrip("\r") + "\n<|end|>" * ends
            for column, value in zip(columns, (row[0], row[1], i, ROLES[role], row[2], piece), strict=True):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in _rows(batches):
            if rows and row[0] != rows[0][0]:
                yield stretch(rows)
                rows = []
            rows.append(row)
        if rows:
            yield stretch(rows)

    return run
