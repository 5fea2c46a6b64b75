"""Rolling window features: per row and window, counts and rank statistics of the same source's rows just before it.

The time of a source is cut into slices. A row enters the slice of its time, leaves the window in the slice of
its time plus the window, and belongs to the first state of every slice that starts in between. First states are
sent as counts by length and language, summed before they are shuffled. A task walks its slices in time order:
at every time it first answers the rows of that time, then lets that time's rows enter a skip list of lengths
and lets those of a window ago leave it; ranks are read from the spans of the list's links. Memory of a task follows
the distinct lengths and languages of a window, whatever the number of rows.

Slices of a source get shorter by powers of two where it is dense, so that a hot source is dealt to many tasks:
some `slice_rows` rows each, or half its distinct lengths if that is more, which keeps first states in proportion to rows.

Defined results: a null text has no length but its row counts as an event and its language counts; a null source
is one source; rows of one time never see each other; repeated rows count as often as they occur. A null
doc_id, or one whose time leaves the range of a long, has no time: its windows are empty and it is in no window. Columns beyond
doc_id, text, lang and source are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import fits_broadcast, stage
from weftline.llm.mixing import _key
from weftline.llm.skiplist import SkipList

WINDOWS = (1800, 86400)
SLICE_ROWS = 2048
_STATE, _ENTER, _LEAVE = 0, 1, 2
_OUT = "k string, w long, event_s long, n_events long, sum_chars long, n_langs long, median_chars long, high_chars long"


def events(docs: DataFrame) -> DataFrame:
    """(doc_id, k, event_s, len, lang): 60 seconds times the floor of (doc_id + crc32 of its digits mod 1000) / 6."""
    moved = F.try_add("doc_id", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 1000)
    rows = docs.select("doc_id", _key(docs["source"]).alias("k"), moved.cast("long").alias("m"), F.char_length("text").cast("long").alias("len"), "lang")
    return rows.select("doc_id", "k", F.expr("try_multiply((m - pmod(m, 6L)) div 6, 60L)").alias("event_s"), "len", "lang")


def _slices(rows: DataFrame, windows: tuple[int, ...], slice_rows: int) -> DataFrame:
    """(k, w, d): the length in seconds of a source's slices for each window."""
    w = F.explode(F.array(*(F.lit(x).cast("long") for x in windows)))
    dense = rows.select("k", "event_s", w.alias("w")).groupBy("k", "w", F.expr("(event_s - pmod(event_s, w)) div w").alias("b")).count().groupBy("k", "w").agg(F.max("count").alias("n"))
    values = rows.groupBy("k", "len").count().groupBy("k").agg(F.count("*").alias("v"))
    ratio = F.col("n") / F.greatest(F.lit(slice_rows), F.floor(F.col("v") / 2))
    step = F.ceil(F.log2(ratio))
    d = F.when(step > 0, F.greatest(F.lit(1), F.floor(F.col("w") / F.pow(F.lit(2.0), F.least(step, F.lit(30)))))).otherwise(F.col("w") * F.pow(F.lit(2.0), F.least(-step, F.lit(30))))
    return dense.join(values, "k").select("k", "w", d.cast("long").alias("d"))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by k, w, slice, at, kind become one row for each k, w and time at which rows enter."""
    group = time = None
    lens, langs, n, total = SkipList(), {}, 0, 0
    pending: list[tuple[int, int | None, str | None, int]] = []
    out: list[list] = [[] for _ in range(8)]

    def settle() -> None:
        nonlocal n, total
        for kind, value, lang, count in pending:
            sign = -count if kind == _LEAVE else count
            n += sign
            if value is not None:
                total += sign * value
                (lens.remove if kind == _LEAVE else lens.add)(value, count)
            if lang is not None:
                left = langs.get(lang, 0) + sign
                if left:
                    langs[lang] = left
                else:
                    del langs[lang]
        pending.clear()

    for batch in batches:
        for k, w, part, at, kind, value, lang, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (k, w, part) != group:
                pending.clear()
                group, time = (k, w, part), None
                lens, langs, n, total = SkipList(), {}, 0, 0
            if kind == _STATE:
                pending.append((kind, value, lang, count))
                settle()
                continue
            if at != time:
                settle()
                time, asked = at, False
            if kind == _ENTER and not asked:
                asked, m = True, lens.size
                row = (k, w, at, n, total, len(langs), lens.at(-(-m // 2)) if m else None, lens.at(-(-99 * m // 100)) if m else None)
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            pending.append((kind, value, lang, count))
        if out[0]:
            yield _batch(out)
            out = [[] for _ in range(8)]


def _batch(columns: list[list]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _OUT.split(", ")]
    return pa.record_batch([pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(columns)], names)


def rolling_features(rows: DataFrame, windows: tuple[int, ...] = WINDOWS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(k, w, event_s, n_events, sum_chars, n_langs, median_chars, high_chars) for every source and time of rows.

    rows(k, event_s, len, lang), read several times: pass a staged table. A window w holds times from event_s - w up to below event_s.
    """
    timed = rows.where("event_s is not null")
    cut = stage(_slices(timed, windows, slice_rows), "slices")
    cut = F.broadcast(cut) if fits_broadcast(cut) else cut
    merged = timed.groupBy("k", "event_s", "len", "lang").agg(F.count("*").alias("n"))
    at = merged.join(cut, "k").withColumn("gone", F.try_add("event_s", "w"))
    part = lambda t: f"({t} - pmod({t}, d)) div d"
    at = at.withColumns({"own": F.expr(part("event_s")), "last": F.expr(part("gone"))})
    enter = at.select("k", "w", F.col("own").alias("part"), F.col("event_s").alias("at"), F.lit(_ENTER).alias("kind"), "len", "lang", "n")
    leave = at.where("gone is not null").select("k", "w", F.col("last").alias("part"), F.col("gone").alias("at"), F.lit(_LEAVE).alias("kind"), "len", "lang", "n")
    held = at.where("last > own").groupBy("k", "w", "d", "own", "last", "len", "lang").agg(F.sum("n").alias("n"))
    held = held.select("k", "w", "d", F.explode(F.expr("sequence(own + 1, last)")).alias("part"), "len", "lang", "n")
    held = held.groupBy("k", "w", "d", "part", "len", "lang").agg(F.sum("n").alias("n"))
    state = held.select("k", "w", "part", (F.col("part") * F.col("d")).alias("at"), F.lit(_STATE).alias("kind"), "len", "lang", "n")
    dealt = enter.unionByName(leave).unionByName(state).repartition("k", "w", "part").sortWithinPartitions("k", "w", "part", "at", "kind")
    return dealt.mapInArrow(_features, _OUT)


def rolling_report(docs: DataFrame, windows: tuple[int, ...] = WINDOWS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Two rows a document (one for each window) with the features of its source's rows before it."""
    rows = stage(events(docs), "events")
    found = rolling_features(rows, windows, slice_rows)
    asked = rows.select("doc_id", "k", "event_s", F.explode(F.array(*(F.lit(x).cast("long") for x in windows))).alias("w"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return asked.join(found, ["k", "w", "event_s"], "left").select(
        "doc_id", F.col("w").alias("window_s"), "event_s", zero("n_events"), zero("sum_chars"), zero("n_langs"), "median_chars", "high_chars"
    )


ROLLING_SQL = r"""
WITH c AS (
  SELECT *, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: [-1 - ascii(substr(doc_id::VARCHAR, i::INT, 1)), 0, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, b: CASE WHEN b < 0 THEN xor(a, -1 - b) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS r
  FROM documents),
d AS (
  SELECT doc_id, source, lang, length(text)::BIGINT AS n, (60 * floor((doc_id + xor(r, 4294967295) % 1000)::DOUBLE / 6))::BIGINT AS event_s FROM c),
w AS (
  SELECT doc_id, 1800::BIGINT AS window_s, event_s, count(*) OVER a AS n_events, sum(n) OVER a AS s, count(DISTINCT lang) OVER a AS n_langs, list_sort(list_filter(list(n) OVER a, lambda x: x IS NOT NULL)) AS l
  FROM d WINDOW a AS (PARTITION BY source ORDER BY event_s RANGE BETWEEN 1800 PRECEDING AND 1 PRECEDING)
  UNION ALL
  SELECT doc_id, 86400::BIGINT, event_s, count(*) OVER a, sum(n) OVER a, count(DISTINCT lang) OVER a, list_sort(list_filter(list(n) OVER a, lambda x: x IS NOT NULL))
  FROM d WINDOW a AS (PARTITION BY source ORDER BY event_s RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING))
SELECT doc_id, window_s, event_s, n_events::BIGINT AS n_events, coalesce(s, 0)::BIGINT AS sum_chars, n_langs::BIGINT AS n_langs,
       l[((len(l) + 1) // 2)::INT]::BIGINT AS median_chars, l[((99 * len(l) + 99) // 100)::INT]::BIGINT AS high_chars
FROM w
"""
