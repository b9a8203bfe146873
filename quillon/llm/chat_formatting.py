"""Operator 8, chat formatting: roles of a plain transcript by a hidden Markov model.

The states are a role's first or later line. A line shows a speaker marker or none, a blank line
before it or none, its place, and its length; these are independent given the state. The model
is counted on transcripts whose roles are known, over all but those of the transcript's own fold,
and smoothed. Viterbi's best path cuts a transcript into turns, which are rendered in one canonical form. A turn keeps its
lines as they stand, blank ones between them too; only a marker at its start is taken off.

A long conversation is held in parts, but its path is one: each part yields the best scores from
every state before it to every state at its end, these are chained along the conversation, and
each part is then cut with the states that the best path has at its borders.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import small_batches, written

ROLES = ("system", "user", "assistant")
STATES = [(r, later) for r in ROLES for later in (False, True)]
#: Turns of a row at most: a longer conversation is held in several. Folds: a conversation is parsed by the model of the others.
PART, FOLDS = 64, 4
#: Names that speakers go by in transcripts.
NAMES = {"system": "system instruction instructions context", "user": "user human q question customer me prompter", "assistant": "assistant ai bot a answer gpt model"}
SPEAKER = {name: role for role, names in NAMES.items() for name in names.split()}
MARKER = re.compile(r"^\s*(?:(?:[#*>\[<|(]+\s*)?([A-Za-z]+)\s*[\]>|)*]*\s*:\s*[*]*|(?:#{1,6}|[\[<(*|]+)\s*([A-Za-z]+)\s*[\]>)*|:]*(?=\s|$))\s*")
LENGTHS = 8
#: Blank lines at a turn's start: no part of its text.
BEFORE = re.compile(r"\A(?:[^\S\n]*\n)+")


def read_line(line: str) -> tuple[str, str]:
    """(role that a marker names, or "", the line without it)."""
    m = MARKER.match(line)
    role = SPEAKER.get((m[1] or m[2]).lower(), "") if m else ""
    return (role, line[m.end() :]) if role else ("", line)


def read_transcript(text: str, goes_on: bool = False) -> list[tuple[tuple, str]]:
    """(features, the line after the blank lines before it) of each line that isn't blank; `goes_on`: a blank line and others stand before."""
    out, blank = [], [""] if goes_on else []
    for line in (text or "").split("\n"):
        if not line.strip():
            blank.append(line)
            continue
        role, rest = read_line(line)
        out.append(((("marker", role), ("blank", bool(blank)), ("first", not (out or goes_on)), ("length", min(LENGTHS - 1, len(rest).bit_length()))), "\n".join([*blank, line])))
        blank = []
    return out


def opening(role: str, lines: str) -> str:
    """A turn's first line, without blank lines before it and without a marker of the turn's role."""
    line = lines.rpartition("\n")[2]
    named, rest = read_line(line)
    return rest if named == role else line


VALUES = {"marker": 4, "blank": 2, "first": 2, "length": LENGTHS}


class Model:
    """Log probabilities from counts: start, step and feature tables."""

    def __init__(self, counts: dict[tuple[str, str, str], float]):
        def table(kind: str, given: str, values: int) -> tuple[dict, float]:
            own = {b: n for (k, a, b), n in counts.items() if k == kind and a == given}
            total = sum(own.values()) + 0.1 * values
            return {b: math.log((n + 0.1) / total) for b, n in own.items()}, math.log(0.1 / total)

        n = len(STATES)
        start, least = table("start", "", n)
        self.start = [start.get(str(s), least) for s in range(n)]
        self.step = []
        for s in range(n):
            row, least = table("step", str(s), n)
            self.step.append([row.get(str(t), least) for t in range(n)])
        self.shown = {f: [table(f, str(s), VALUES[f]) for s in range(n)] for f in VALUES}
        self.cache: dict[tuple, list[float]] = {}

    def emission(self, features: tuple) -> list[float]:
        if features not in self.cache:
            self.cache[features] = [sum(self.shown[f][s][0].get(str(v), self.shown[f][s][1]) for f, v in features) for s in range(len(STATES))]
        return self.cache[features]

    def best_path(self, lines: list[tuple[tuple, str]], entry: int | None = None, last: int | None = None) -> list[int]:
        """Viterbi, from the state `entry` of a line before and to the state `last`, if given; ties go to the state listed first."""
        if not lines:
            return []
        score = [a + b for a, b in zip(self.start if entry is None else self.step[entry], self.emission(lines[0][0]))]
        back, states = [], range(len(STATES))
        for features, _ in lines[1:]:
            shown = self.emission(features)
            from_, new = [], []
            for t in states:
                best = max(states, key=lambda s: score[s] + self.step[s][t])
                from_.append(best)
                new.append(score[best] + self.step[best][t] + shown[t])
            back.append(from_)
            score = new
        path = [max(states, key=score.__getitem__) if last is None else last]
        for from_ in reversed(back):
            path.append(from_[path[-1]])
        return path[::-1]

    def through(self, lines: list[tuple[tuple, str]], goes_on: bool) -> tuple[list[float], list[int]]:
        """For each state before the lines and each at their end: the best path's score, and its first state."""
        scores, firsts, states = [], [], range(len(STATES))
        for entry in states:
            score = [a + b for a, b in zip(self.step[entry] if goes_on else self.start, self.emission(lines[0][0]))]
            first = list(states)
            for features, _ in lines[1:]:
                shown = self.emission(features)
                from_ = [max(states, key=lambda s: score[s] + self.step[s][t]) for t in states]
                score = [score[s] + self.step[s][t] + shown[t] for t, s in enumerate(from_)]
                first = [first[s] for s in from_]
            scores.extend(score)
            firsts.extend(first)
        return scores, firsts

    def pieces(self, text: str, entry: int | None = None, last: int | None = None, following: int | None = None) -> list[tuple[str, str, bool, bool]]:
        """(role, text, begins here, ends here) of each turn; `following` is the state of the next part's first line."""
        lines = read_transcript(text, entry is not None)
        path = self.best_path(lines, entry, last)
        open_left = bool(path) and entry is not None and STATES[path[0]] == (STATES[entry][0], True)
        open_right = bool(path) and following is not None and STATES[following] == (STATES[path[-1]][0], True)
        out: list[tuple[str, list[str]]] = []
        for state, (_, line) in zip(path, lines):
            role, later = STATES[state]
            if later and out and out[-1][0] == role:
                out[-1][1].append(line)
            else:
                out.append((role, [line if open_left and not out else opening(role, line)]))
        found = []
        for i, (role, lines) in enumerate(out):
            begins, ends = not (open_left and i == 0), not (open_right and i == len(out) - 1)
            body = "\n".join(lines)
            body = BEFORE.sub("", body) if begins else body
            found.append((role, body.rstrip() if ends else body, begins, ends))
        return found

    def turns(self, text: str) -> list[tuple[str, str]]:
        return [(role, body) for role, body, _, _ in self.pieces(text)]


def render(turns: list[tuple[str, str]]) -> str:
    """The canonical form."""
    return render_pieces([(role, text, True, True) for role, text in turns])


def render_pieces(pieces: list[tuple[str, str, bool, bool]]) -> str:
    """The canonical form of turns, or of what a part holds of them: the parts' forms in a row are the conversation's."""
    return "".join((f"<|{role}|>\n" if begins else "") + f"{text}\n" + ("<|end|>\n" if ends else "") for role, text, begins, ends in pieces)


def _mark(style: int, role: str) -> str:
    name = {"system": "System", "user": "User", "assistant": "Assistant"}[role]
    return (f"{name}: ", f"### {name}\n", f"[{name.lower()}] ", f"**{ {'User': 'Human', 'Assistant': 'AI'}.get(name, name) }**: ")[style]


def _write(turns: list[dict]) -> tuple[str, list[tuple[str, str]]]:
    """A plain transcript of known turns: four marker styles, and one marker in five left out."""
    parts, known = [], []
    for t in turns:
        role = t["role"] if t["role"] in ROLES else "user"
        text = t["text"] or ""
        if not text.strip():
            continue
        parts.append((_mark(t["style"], role) if t["marked"] else "") + text)
        known.append((role, text))
    return "\n\n".join(parts), known


def _last_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state of the last line of each part that has lines."""
    for batch in batches:
        found = [[STATES.index((role, n > 1)) for role, n in _bodies(turns)][-1:] for turns in batch["turns"].to_pylist()]
        at = pa.array([i for i, x in enumerate(found) if x], pa.int64())
        yield pa.RecordBatch.from_arrays([batch["conv_id"].take(at), batch["part"].take(at), pa.array([x[0] for x in found if x], pa.int32())], ["conv_id", "part", "ends"])


def _with(parts: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """parts with the columns of rows, null where there are none; null keys are equal."""
    rows = rows.withColumnsRenamed({k: f"of_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]
    return parts.join(rows.hint("shuffle_merge"), on, "left").drop(*[f"of_{k}" for k in keys])


def transcripts(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, turns, fold, several, before): the turns of each conversation, PART to a row; equal rows count once.

    fold: a hash of the conversation, below FOLDS; several: the conversation has more parts; before: the state of the line before the part, null for none.
    """
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(0))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), "text").distinct()
    rows = rows.withColumn("part", F.floor(turn / PART))
    kinds = F.struct("turn", "role", "text", F.pmod(F.xxhash64("conv_id", F.lit("style")), F.lit(4)).cast("int").alias("style"), (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5)) != 0).alias("marked"))
    parts = written(rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(kinds)).alias("turns")).withColumn("fold", F.pmod(F.xxhash64("conv_id", F.lit("fold")), F.lit(FOLDS)).cast("int")), "transcripts")
    long = written(parts.groupBy("conv_id").agg(F.count("*").alias("parts")).where("parts > 1").select("conv_id", F.lit(True).alias("several")), "long")
    if not long.take(1):
        return parts.withColumns({"several": F.lit(False), "before": F.lit(None).cast("int")})
    parts = _with(parts, long, "conv_id").withColumn("several", F.coalesce("several", F.lit(False)))
    (kind,) = [t for c, t in parts.dtypes if c == "conv_id"]
    ends = parts.where("several").select("conv_id", "part", "turns").mapInArrow(_last_states, f"conv_id {kind}, part long, ends int")
    before = ends.select("conv_id", "part", F.lag("ends").over(Window.partitionBy("conv_id").orderBy("part")).alias("before"))
    return written(_with(parts, before, "conv_id", "part"), "parts")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    folds = [Counter() for _ in range(FOLDS)]
    for batch in batches:
        for turns, entry, fold in zip(*[batch[c].to_pylist() for c in ("turns", "before", "fold")]):
            counts = folds[fold]
            before = None if entry is None else str(entry)
            # lines belong to the turn that wrote them: a turn's lines are read where they stand
            text, known = _write(turns)
            lines = read_transcript(text, entry is not None)
            owners = [(role, i > 0) for role, body in _bodies(turns) for i in range(body)]
            for (features, _), owner in zip(lines, owners):
                state = str(STATES.index(owner))
                counts["start", "", state] += before is None
                if before is not None:
                    counts["step", before, state] += 1
                for f, v in features:
                    counts[f, state, str(v)] += 1
                before = state
    rows = [(*k, n, fold) for fold, counts in enumerate(folds) for k, n in counts.items() if n]
    columns = list(zip(*rows)) if rows else [(), (), (), (), ()]
    yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in columns[:3]], pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int32())], ["kind", "given", "value", "n", "fold"])


def _bodies(turns: list[dict]) -> Iterator[tuple[str, int]]:
    """(role, lines that aren't blank) of each written turn."""
    for t in turns:
        text, known = _write([t])
        if known:
            yield known[0][0], len(read_transcript(text))


def fit(parts: DataFrame) -> list[Model]:
    """For each fold of the conversations, the model counted on all others: a few hundred sums reach the driver.

    So no transcript is scored by what was counted on it. If there are no others, all are counted.
    """
    rows = parts.select("turns", "before", "fold").mapInArrow(_counted, "kind string, given string, value string, n long, fold int").groupBy("kind", "given", "value", "fold").agg(F.sum("n").alias("n")).collect()

    def model(without: int | None) -> Model:
        counts: Counter = Counter()
        for r in rows:
            if r["fold"] != without:
                counts[r["kind"], r["given"], r["value"]] += r["n"]
        return Model(counts)

    return [model(fold if any(r["fold"] != fold for r in rows) else None) for fold in range(FOLDS)]


def _through(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The scores and first states of each part that has lines."""
    for batch in batches:
        at, scores, firsts = [], [], []
        for i, (turns, before, fold) in enumerate(zip(*[batch[c].to_pylist() for c in ("turns", "before", "fold")])):
            lines = read_transcript(_write(turns)[0], before is not None)
            if lines:
                one, two = model.value[fold].through(lines, before is not None)
                at.append(i), scores.append(one), firsts.append(two)
        rows = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([batch["conv_id"].take(rows), batch["part"].take(rows), pa.array(scores, pa.list_(pa.float64())), pa.array(firsts, pa.list_(pa.int32()))], ["conv_id", "part", "scores", "firsts"])


def chain(parts: list[tuple[list[float], list[int]]]) -> list[tuple[int | None, int, int | None]]:
    """(state before, last state, first state after) of each part on the best path of the whole; parts are (scores, firsts)."""
    n = len(STATES)
    score, back = parts[0][0][:n], []
    for scores, _ in parts[1:]:
        from_ = [max(range(n), key=lambda s: score[s] + scores[s * n + t]) for t in range(n)]
        score = [score[s] + scores[s * n + t] for t, s in enumerate(from_)]
        back.append(from_)
    path = [max(range(n), key=score.__getitem__)]
    for from_ in reversed(back):
        path.append(from_[path[-1]])
    path.reverse()
    after = [firsts[s * n + t] for (_, firsts), s, t in zip(parts[1:], path, path[1:])]
    return list(zip([None, *path], path, [*after, None]))


def _chained(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by conversation and part."""

    def linked(conv, held: list[tuple]) -> pa.RecordBatch:
        columns = [[conv] * len(held), [h[0] for h in held], *zip(*chain([h[1:] for h in held]))]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    conv, held = None, []
    for batch in batches:
        for row in zip(*[batch[c].to_pylist() for c in ("conv_id", "part", "scores", "firsts")]):
            if held and row[0] != conv:
                yield linked(conv, held)
                held = []
            conv = row[0]
            held.append(row[1:])
    if held:
        yield linked(conv, held)


def borders(parts: DataFrame, model) -> DataFrame:
    """(conv_id, part, entry, last, following): the best path's states around each part of a conversation that has several.

    One row of 72 numbers for each part comes together by conversation; texts do not.
    """
    (field,) = [f for f in parts.schema if f.name == "conv_id"]
    kind = field.dataType.simpleString()
    spans = parts.where("several").select("conv_id", "part", "turns", "before", "fold").mapInArrow(partial(_through, model), f"conv_id {kind}, part long, scores array<double>, firsts array<int>")
    schema = pa.schema([("conv_id", to_arrow_type(field.dataType)), ("part", pa.int64()), *[(c, pa.int32()) for c in ("entry", "last", "following")]])
    return spans.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(partial(_chained, schema), f"conv_id {kind}, part long, entry int, last int, following int")


def _parsed(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    models = model.value
    for batch in batches:
        n, found, agreed, out = [], [], [], []
        for turns, fold, *around in zip(*[batch[c].to_pylist() for c in ("turns", "fold", "entry", "last", "following")]):
            text, known = _write(turns)
            pieces = models[fold].pieces(text, *around)
            got = [(role, body) for role, body, begins, ends in pieces if begins and ends]
            right = Counter((role, body.strip()) for role, body in known) & Counter((role, body.strip()) for role, body in got)
            n.append(len(known))
            found.append(sum(begins for _, _, begins, _ in pieces))
            agreed.append(sum(right.values()))
            out.append(render_pieces(pieces))
        yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["part"], *[pa.array(c, pa.int64()) for c in (n, found, agreed)], pa.array(out, pa.string())], ["conv_id", "part", "n_turns", "n_parsed", "n_agreed", "rendered"])


def chat_formatting(conversations: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, n_parsed, n_agreed, rendered: conversations written as plain transcripts and parsed again.

    Null and blank texts are no turns; a conversation of nothing else renders "". A null or
    unknown role counts as user. Equal rows count once; of rows with one turn number, the order
    is by role and text. A row holds PART turn numbers, so no conversation is gathered whole; the
    path is that of the whole conversation, and its rendering is its rows' in the order of part.
    A turn that goes on in the next row counts as parsed where it begins.
    n_agreed counts the turns found again with their role and text, but for white space around it.
    """
    small_batches(conversations.sparkSession)
    parts = transcripts(conversations)
    model = conversations.sparkSession.sparkContext.broadcast(fit(parts))
    (kind,) = [t for c, t in conversations.dtypes if c == "conv_id"]
    if parts.where("several").take(1):
        parts = _with(parts, written(borders(parts, model), "borders"), "conv_id", "part")
    else:
        parts = parts.withColumns({c: F.lit(None).cast("int") for c in ("entry", "last", "following")})
    return parts.select("conv_id", "part", "turns", "fold", "entry", "last", "following").mapInArrow(partial(_parsed, model), f"conv_id {kind}, part long, n_turns long, n_parsed long, n_agreed long, rendered string")


def _formatted(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["conv_id"], pa.array([render(model.value.turns(t)) for t in batch["transcript"].to_pylist()], pa.string())], ["conv_id", "rendered"])


def format_transcripts(plain: DataFrame, model: Model) -> DataFrame:
    """conv_id, rendered for each row of plain (conv_id, transcript); null and blank transcripts render ""."""
    small_batches(plain.sparkSession)
    shared = plain.sparkSession.sparkContext.broadcast(model)
    (kind,) = [t for c, t in plain.dtypes if c == "conv_id"]
    return plain.select("conv_id", "transcript").mapInArrow(partial(_formatted, shared), f"conv_id {kind}, rendered string")
