"""Row-to-text model calls and batched classification.

Python runs per row here. Answers are parsed in the JVM; the Python side passes
Arrow batches through and adds the response columns. Prompts come as a column, or, where several are made from the
same texts, are filled in by the worker (``Wording``), so that a text is sent to it once.
"""

from __future__ import annotations

import heapq
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from string import Formatter
from typing import NamedTuple

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelab.functions.text import clean_response, text_key
from cuelab.operators.skew import salted_join


class Request(NamedTuple):
    system: str | None
    user: str


@dataclass(frozen=True)
class Params:
    """What the backend should do with a request, and how failures are handled."""

    max_in_tokens: int | None = 1024
    max_out_tokens: int = 256
    temperature: float = 0.0
    top_p: float = 0.95
    top_k: int = 20
    do_sample: bool = False
    stop: tuple[str, ...] = ()
    batch_size: int = 32
    attempts: int = 3
    backoff_s: float = 30.0
    fail_fast: bool = False


# Limits and sampling of each task.
INJECT = Params(max_in_tokens=512, max_out_tokens=256, temperature=1.0, do_sample=True)
DETECT = Params(max_in_tokens=1024, max_out_tokens=128)
REWRITE = Params(max_in_tokens=1024, max_out_tokens=256)
JUDGE = Params(max_in_tokens=1024, max_out_tokens=128)
SENTIMENT = Params(max_in_tokens=1024, max_out_tokens=1024)

#: The stages of the jobs, as they are named in the map of errors.
STAGES = ("inject", "detect", "rewrite", "judge", "sentiment")

Backend = Callable[[list[Request]], Sequence[str]]
BackendFactory = Callable[[Params], Backend]


@dataclass(frozen=True)
class Call:
    """One response column: where its prompt is and which system prompt goes with it.

    The system prompt is one text for all rows, a column, or a text per value of a column
    (``system_by``): the last sends short names to Python, not the same long text in every row.
    """

    out_col: str
    prompt_col: str = "prompt"
    system: str | None = None
    system_col: str | None = None
    system_by: tuple[str, Mapping[str, str]] | None = None

    def systems(self, batch) -> list[str | None]:
        """The system prompt of every row of an Arrow batch."""
        if self.system_by:
            column, texts = self.system_by
            return [texts.get(v) for v in batch.column(column).to_pylist()]
        if self.system_col:
            return batch.column(self.system_col).to_pylist()
        return [self.system] * batch.num_rows


@dataclass(frozen=True)
class Wording:
    """A prompt that the worker fills in: a ``{slot}`` template and the text column of each slot.

    A missing value makes the prompt missing, unless ``missing`` names the text to show instead (see ``plans.prompts.render``,
    which does the same with columns).
    """

    template: str
    slots: Mapping[str, str]
    system: str | None = None
    missing: str | None = None

    def pieces(self) -> list[tuple[str, str | None]]:
        """Texts of the template, each with the column that follows it."""
        return [(text, self.slots[slot] if slot is not None else None) for text, slot, _, _ in Formatter().parse(self.template)]

    def columns(self) -> list[str]:
        return [c for _, c in self.pieces() if c is not None]

    def filler(self, texts: Mapping[str, list]) -> Callable[[int], str | None]:
        """From the columns of a batch the function that makes a row's prompt."""
        form = "".join(text.replace("%", "%%") + ("%s" if c is not None else "") for text, c in self.pieces())
        columns, missing = [texts[c] for c in self.columns()], self.missing

        def fill(at: int) -> str | None:
            values = [column[at] for column in columns]
            if None in values:
                if missing is None:
                    return None
                values = [missing if v is None else v for v in values]
            return form % tuple(values)

        return fill


#: Rows of a task that wait for another attempt; beyond that the task waits with them.
MOST_WAITING = 10_000
#: Batches of requests whose prompts are Python texts at once.
BATCHES_AT_ONCE = 2
#: An Arrow batch is gone through in slices of about so many bytes, so that its texts are not all Python texts at once.
SLICE_BYTES = 4 << 20


def _slices(batch, size: int, nbytes: int = 0) -> Iterator:
    """A batch in parts of ``SLICE_BYTES`` on average, each of whole batches of ``size`` requests; ``nbytes``: what it grows to."""
    rows = batch.num_rows * SLICE_BYTES // max(batch.nbytes, nbytes, 1) // size * size or size
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _sent(backend: Backend, requests: list[Request]) -> list[str | None]:
    out = list(backend(requests))
    if len(out) != len(requests):
        raise ValueError(f"{len(out)} responses for {len(requests)} requests")
    return out


def _sent_or_raised(backend: Backend, requests: list[Request], params: Params) -> list[str | None]:
    """All answers, or the last failure after all attempts."""
    for attempt in range(params.attempts):
        if attempt:
            time.sleep(params.backoff_s)
        try:
            return _sent(backend, requests)
        except Exception as e:
            problem = e
    raise problem


class _Row:
    """A row on its way: its requests by call, and what came back."""

    __slots__ = ("batch", "at", "requests", "answers", "problems", "attempts")

    def __init__(self, batch, at: int, calls: int):
        self.batch, self.at = batch, at
        self.requests: dict[int, Request] = {}
        self.answers: list[str | None] = [None] * calls
        self.problems: dict[int, Exception] = {}
        self.attempts = 0


class _Caller:
    """The calls of one task.

    A batch of requests that fails is sent request by request, so that one bad prompt does not take its neighbours
    down. What fails alone waits: it is sent again when it is due, and the task goes on meanwhile. (Without a
    time to wait it is sent again at once.) Only when nothing else is left, or ``MOST_WAITING`` rows wait, does the task wait too.
    """

    def __init__(self, backend: Backend, calls: Sequence[Call], params: Params, clock=time.monotonic, sleep=time.sleep):
        self.backend, self.calls, self.params, self.clock, self.sleep = backend, calls, params, clock, sleep
        self.waiting: list[tuple[float, int, _Row]] = []  # by due time; the number breaks ties
        self.number = 0

    def rows(self, batch) -> list[_Row]:
        out = [_Row(batch, i, len(self.calls)) for i in range(batch.num_rows)]
        for c, call in enumerate(self.calls):
            for row, prompt, system in zip(out, batch.column(call.prompt_col).to_pylist(), call.systems(batch)):
                if prompt is not None:
                    row.requests[c] = Request(system, prompt)
        return out

    def worded_rows(self, batch, asked: Sequence[tuple[int, int]], fillers: Sequence[tuple[Callable, str | None]]) -> list[_Row]:
        """The rows of ``batch`` with prompts that are filled in: each from the row and by the wording that ``asked`` names."""
        out = []
        for i, (at, k) in enumerate(asked):
            row = _Row(batch, i, 1)
            fill, system = fillers[k]
            prompt = fill(at)
            if prompt is not None:
                row.requests[0] = Request(system, prompt)
            out.append(row)
        return out

    def first_attempt(self, rows: list[_Row]) -> list[_Row]:
        """Send all requests of these rows; the rows that are through."""
        size = self.params.batch_size
        for c in range(len(self.calls)):
            todo = [r for r in rows if c in r.requests]
            for at in range(0, len(todo), size):
                part = todo[at : at + size]
                if len(part) > 1:
                    self._send(part, c)
                else:
                    self._send_alone(part[0], c)
        return self._settled(rows)

    def _send(self, rows: list[_Row], c: int) -> None:
        requests = [r.requests[c] for r in rows]
        try:
            answers = _sent_or_raised(self.backend, requests, self.params) if self.params.fail_fast else _sent(self.backend, requests)
        except Exception as e:  # the backend is foreign code: any failure is a row-level error
            if self.params.fail_fast:
                raise
            if len(rows) > 1:
                for row in rows:
                    self._send_alone(row, c)
            else:
                # without the frames that it came through: they hold the row, and the row its whole batch
                e.__traceback__ = e.__context__ = e.__cause__ = None
                rows[0].problems[c] = e
            return
        for row, answer in zip(rows, answers):
            row.answers[c] = answer
            if row.problems:
                row.problems.pop(c, None)

    def _send_alone(self, row: _Row, c: int) -> None:
        for _ in range(1 if self.params.backoff_s else self.params.attempts):
            self._send([row], c)
            if c not in row.problems:
                break

    def _settled(self, rows: list[_Row]) -> list[_Row]:
        """Rows without a failure, or without an attempt left; the others wait."""
        through, due = [], self.clock() + self.params.backoff_s
        for row in rows:
            row.attempts += 1
            if row.problems and self.params.backoff_s and row.attempts < self.params.attempts:
                # a copy of the row alone, so that it does not hold its whole batch
                row.batch, row.at = row.batch.take([row.at]), 0
                heapq.heappush(self.waiting, (due, self.number, row))
                self.number += 1
            else:
                through.append(row)
        return through

    def again(self, finish: bool = False) -> Iterator[list[_Row]]:
        """Send what is due; with ``finish`` until nothing waits any more. Yields the rows that are through."""
        while self.waiting:
            left = self.waiting[0][0] - self.clock()
            if left > 0:
                if not finish and len(self.waiting) <= MOST_WAITING:
                    return
                self.sleep(left)
            due = []
            now = self.clock()
            while self.waiting and self.waiting[0][0] <= now and len(due) < self.params.batch_size:
                due.append(heapq.heappop(self.waiting)[2])
            for row in due:  # alone, as they failed alone
                for c in list(row.problems):
                    self._send([row], c)
            yield self._settled(due)


def _worded(part, asked_col: str, wordings: Sequence[Wording], kept: list[str], number_col: str):
    """Of rows that hold the numbers of the wordings to ask: a row of the ``kept`` columns and the number for each prompt, which
    row and wording each is made of, and how."""
    import numpy as np
    import pyarrow as pa

    numbers = part.column(asked_col)
    flat = numbers.flatten()
    origin = np.repeat(np.arange(part.num_rows), numbers.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    at = pa.array(origin, pa.int64())
    batch = pa.RecordBatch.from_arrays([*(part.column(n).take(at) for n in kept), flat], names=[*kept, number_col])
    texts = {c: part.column(c).to_pylist() for c in {c for w in wordings for c in w.columns()}}
    return batch, list(zip(origin.tolist(), flat.to_pylist())), [(w.filler(texts), w.system) for w in wordings]


def _arrow_caller(
    factory: BackendFactory, calls: Sequence[Call], params: Params, kept: list[str], error_col: str,
    wordings: Sequence[Wording] = (), asked_col: str = "", number_col: str = "",
):
    sent_kept, kept = kept, kept + [number_col] if wordings else kept
    at_once = params.batch_size * BATCHES_AT_ONCE

    def error_of(row: _Row) -> str | None:
        if not row.problems:
            return None
        last = max(row.problems)
        return f"{calls[last].out_col}: {type(row.problems[last]).__name__}: {row.problems[last]}"

    def prompts(caller: _Caller, whole) -> Iterator:
        """Slices, each with the function that makes the rows from one place to another."""
        if not wordings:
            for batch in _slices(whole, params.batch_size):
                yield batch, lambda a, b, batch=batch: caller.rows(batch.slice(a, b - a))
            return
        grown = len(wordings) * sum(whole.column(n).nbytes for n in sent_kept)
        for part in _slices(whole, params.batch_size, grown):
            batch, asked, fillers = _worded(part, asked_col, wordings, sent_kept, number_col)
            yield batch, lambda a, b, batch=batch, asked=asked, fillers=fillers: caller.worded_rows(batch.slice(a, b - a), asked[a:b], fillers)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        caller = _Caller(factory(params), calls, params)  # once per task

        def out(answers: list[list], errors: list, columns: list) -> pa.RecordBatch:
            names = kept + [c.out_col for c in calls] + [error_col]
            answered = [pa.array(a, pa.string()) for a in answers]
            return pa.RecordBatch.from_arrays([*columns, *answered, pa.array(errors, pa.string())], names=names)

        def late(finish: bool) -> Iterator:
            for rows in caller.again(finish):
                if rows:
                    columns = [pa.concat_arrays([r.batch.column(n) for r in rows]) for n in kept]
                    answers = [[r.answers[c] for r in rows] for c in range(len(calls))]
                    yield out(answers, [error_of(r) for r in rows], columns)

        for whole in batches:
            for batch, rows_of in prompts(caller, whole):
                through, answers, errors = [], [[] for _ in calls], []
                for a in range(0, batch.num_rows, at_once):
                    rows = caller.first_attempt(rows_of(a, min(a + at_once, batch.num_rows)))
                    through += [a + r.at for r in rows]
                    for c, column in enumerate(answers):
                        column += [r.answers[c] for r in rows]
                    errors += [error_of(r) for r in rows]
                if len(through) < batch.num_rows:
                    batch = batch.take(pa.array(through, pa.int64()))
                yield out(answers, errors, [batch.column(n) for n in kept])
                yield from late(finish=False)
        yield from late(finish=True)

    return run


def generate(
    df: DataFrame,
    factory: BackendFactory,
    calls: Sequence[Call],
    params: Params = Params(),
    *,
    partitions: int | None = None,
    spread_by: Sequence[str] = (),
    drop: Sequence[str] = (),
    error_col: str = "error",
) -> DataFrame:
    """Call the model once per row and per entry of ``calls``; adds the response columns.

    Several calls of one row happen in one pass, without exploding the row and pivoting back.
    A NULL prompt makes no call. A request that fails is sent again after ``backoff_s`` while the task goes on
    with others; rows may so change their order. After the last attempt a failed row keeps a NULL response and
    its message in ``error_col``. ``partitions`` sets the number of concurrent callers; the rows
    are spread by the hash of the columns that identify them, which a retried task reproduces. Columns in
    ``drop`` (prompts, as a rule) are not shipped back.

    Filter before calling: Spark does not push a filter through this step. Write the result
    before using it twice (``workspace.materialise``), and switch speculative execution off.
    """
    if partitions:
        if not spread_by:
            raise ValueError("name columns in spread_by that identify a row")
        df = df.repartition(partitions, *spread_by)
    kept = [c for c in df.columns if c not in set(drop)]
    schema = T.StructType(
        [df.schema[c] for c in kept]
        + [T.StructField(c.out_col, T.StringType()) for c in calls]
        + [T.StructField(error_col, T.StringType())]
    )
    out = df.mapInArrow(_arrow_caller(factory, list(calls), params, kept, error_col), schema)
    return out.withColumns({c.out_col: clean_response(F.col(c.out_col), params.stop) for c in calls})


def generate_worded(
    df: DataFrame,
    factory: BackendFactory,
    out_col: str,
    wordings: Sequence[Wording],
    params: Params = Params(),
    *,
    asked_col: str,
    number_col: str,
    partitions: int | None = None,
    spread_by: Sequence[str] = (),
    drop: Sequence[str] = (),
    error_col: str = "error",
) -> DataFrame:
    """Like ``generate`` for several prompts that are made from the same texts: a row for each row of ``df`` and each number in
    its array ``asked_col``, the places in ``wordings`` of the prompts to send.

    ``number_col`` says which one an answer is to. Rows go to Python once, not once for each prompt, and the prompts are
    filled in there; a row without a number goes away. Columns in ``drop`` (texts, as a rule) are not shipped back.
    """
    if partitions:
        if not spread_by:
            raise ValueError("name columns in spread_by that identify a row")
        df = df.repartition(partitions, *spread_by)
    kept = [c for c in df.columns if c not in {*drop, asked_col}]
    schema = T.StructType(
        [df.schema[c] for c in kept]
        + [T.StructField(number_col, T.IntegerType()), T.StructField(out_col, T.StringType()), T.StructField(error_col, T.StringType())]
    )
    caller = _arrow_caller(factory, [Call(out_col)], params, kept, error_col, list(wordings), asked_col, number_col)
    return df.mapInArrow(caller, schema).withColumn(out_col, clean_response(F.col(out_col), params.stop))


def generate_distinct(
    df: DataFrame,
    factory: BackendFactory,
    call: Call,
    params: Params = Params(),
    *,
    row_id: str,
    error_col: str = "error",
) -> DataFrame:
    """Like ``generate`` with one call, but equal prompts are sent once.

    For deterministic backends. A prompt shared by a large part of the rows is reduced before
    the shuffle on the way in and salted on the way back.
    """
    if call.system_by:
        column, texts = call.system_by
        named = [F.when(F.col(column).eqNullSafe(F.lit(k)), F.lit(v)) for k, v in texts.items()]
        system = F.coalesce(*named, F.lit(None).cast("string"))
    else:
        system = F.col(call.system_col) if call.system_col else F.lit(call.system)
    marked = F.coalesce(F.concat(F.lit("+"), system), F.lit("-"))  # none is not the same as an empty one
    keyed = df.withColumn("__prompt_key", text_key(F.concat(marked, F.lit("\x00"), F.col(call.prompt_col))))
    # Whole rows as keys of the grouping: a hash table drops equal ones, and prompts are not sorted to find the first of each key.
    once = (
        keyed.filter(F.col("__prompt_key").isNotNull())
        .select("__prompt_key", system.cast("string").alias("__system"), F.col(call.prompt_col))
        .distinct()
    )
    answered = generate(
        once,
        factory,
        [Call(call.out_col, call.prompt_col, system_col="__system")],
        params,
        drop=["__system", call.prompt_col],
        error_col=error_col,
    )
    return salted_join(keyed, answered, ["__prompt_key"], row_id=row_id, digested=True).drop("__prompt_key")


def classify(
    df: DataFrame,
    text_col: str,
    make_classifier: Callable[[], Callable[[Sequence[str]], Sequence[str]]],
    label_map: Mapping[str, str],
    *,
    out_col: str = "predicted_sentiment",
    batch_size: int = 32,
) -> DataFrame:
    """Run a batched classifier and map its classes to the dataset's labels.

    The classifier is made once per worker. A missing text is not classified; a class outside
    ``label_map`` gives NULL, to be counted by ``analysis.null_rate``.
    """

    def make():
        import numpy as np

        classifier = make_classifier()

        def predict(texts):
            return np.array(list(classifier([str(t) for t in texts])), dtype=object)

        return predict

    predict = predict_batch_udf(make, return_type=T.StringType(), batch_size=batch_size)
    labels = F.create_map(*[F.lit(x) for pair in label_map.items() for x in pair])
    raw = predict(F.coalesce(F.col(text_col), F.lit("")))
    return (
        df.withColumn("__class", raw)
        .withColumn(out_col, F.when(F.col(text_col).isNotNull(), F.try_element_at(labels, F.col("__class"))))
        .drop("__class")
    )
