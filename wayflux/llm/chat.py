"""Chat formatting into budgeted, turn-aligned windows.

Prefix sums of turn tokens place every turn on its conversation's token line. The line is cut into slots of the size
that the budget leaves beside the system turn and the history; turns inside a slot form a window's targets, and a turn
that crosses a slot's end is a window of its own. Each window repeats the system turn and as many turns before it as
the history budget holds; repeated turns are never under the loss mask, so every assistant turn is learnt once.

Template: ``<s>[role]\\ntext</s>\\n`` per turn. Inside roles and texts a backslash goes before every backslash, ``<``,
``[`` and ``]``, so no text can form a control string, and removing these backslashes restores it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayflux.checkpoints import checkpoint
from wayflux.llm.common import text_or_empty

WINDOW_TOKENS, HISTORY_TOKENS = 512, 128
#: Turns whose prefix sums one window function runs over; blocks of turns are then added up per conversation.
BLOCK_TURNS = 1024

_TURN = re.compile(r"<s>\[((?:[^\]\\]|\\.)*)\]\n((?:[^<\\]|\\.)*)</s>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[\]])", r"\\$1")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def quarter_of_chars(rendered: Column) -> Column:
    """Tokens of a rendered turn, taken as a quarter of its code points, at least one."""
    return F.ceil(F.length(rendered) / 4)


def turn_spans(turns: DataFrame, tokens: Callable[[Column], Column], window: int, history: int) -> DataFrame:
    """Each turn with its position, its place on the token line, its slot size and its window's number (span)."""
    rendered = F.concat(F.lit("<s>["), escaped("role"), F.lit("]\n"), escaped("text"), F.lit("</s>\n"))
    rows = turns.withColumn("tokens", F.greatest(F.lit(1).cast("long"), tokens(rendered).cast("long")))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(2**40)).cast("long")))
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    inside = Window.partitionBy("conv_id", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("in_tokens", F.sum("tokens").over(inside)).withColumn("in_turns", F.count(F.lit(1)).over(inside))
    # One row per block of turns: the sums before it, and what the conversation as a whole has.
    first = F.min(F.when(F.col("in_turns") == 1, F.struct(F.col("role"), F.col("tokens"))))
    blocks = rows.groupBy("conv_id", "block").agg(F.sum("tokens").alias("b_tokens"), F.count(F.lit(1)).alias("b_turns"), first.alias("first"))
    so_far = Window.partitionBy("conv_id").orderBy("block")
    before = so_far.rowsBetween(Window.unboundedPreceding, -1)
    whole = so_far.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        F.col("conv_id").alias("c"), F.col("block").alias("b"),
        F.coalesce(F.sum("b_tokens").over(before), F.lit(0)).alias("tokens_before"), F.coalesce(F.sum("b_turns").over(before), F.lit(0)).alias("turns_before"),
        F.sum("b_turns").over(whole).alias("n_turns"), F.first("first").over(whole).alias("first"),
    )
    leads = (F.col("first.role") == "system") & (F.col("n_turns") > 1)
    blocks = blocks.withColumn("system_tokens", F.when(leads, F.col("first.tokens")).otherwise(0)).drop("first")
    rows = rows.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).drop("c", "b", "block")
    rows = rows.withColumn("position", F.col("turns_before") + F.col("in_turns") - 1)
    rows = rows.withColumn("system", (F.col("position") == 0) & (F.col("system_tokens") > 0))
    rows = rows.withColumn("end", F.col("tokens_before") + F.col("in_tokens") - F.col("system_tokens")).withColumn("start", F.col("end") - F.col("tokens"))
    rows = rows.withColumn("slot_size", F.greatest(F.lit(1).cast("long"), F.lit(window - history) - F.col("system_tokens")))
    slot = F.floor(F.col("start") / F.col("slot_size"))
    crosses = F.floor((F.col("end") - 1) / F.col("slot_size")) > slot
    return rows.withColumn("span", F.when(~F.col("system"), 2 * slot + crosses.cast("long"))).select("conv_id", "position", "role", "text", "system", "start", "end", "slot_size", "span")


def windows(conversations: DataFrame, tokens: Callable[[Column], Column] = quarter_of_chars, window: int = WINDOW_TOKENS, history: int = HISTORY_TOKENS) -> DataFrame:
    """conv_id, span, n_context, formatted, loss of conversations(conv_id, turn, role, text).

    ``formatted`` is a window's text: ``n_context`` repeated turns (the system turn, then history), then its own.
    ``loss`` lists the code point ranges of its own assistant texts. A leading system turn is repeated in all windows
    but the first. A window is within the budget unless its system turn, or one single turn, is larger than that. Rows
    go by turn (nulls first), ties by role and text; null roles and texts count as empty, a null conv_id is a
    conversation; repeated rows are repeated turns. Other columns are not read.
    """
    turns = conversations.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), text_or_empty(F.col("text")).alias("text"))
    placed = checkpoint(turn_spans(turns, tokens, window, history))  # four branches read it
    spans = placed.filter(~F.col("system")).groupBy("conv_id", "span").agg(F.min("start").alias("begin"))
    spans = spans.select(F.col("conv_id").alias("c"), F.col("span").alias("s"), "begin")
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    fields = ["conv_id", "at", "position", "role", "text"]
    own = placed.filter(~F.col("system")).withColumn("at", F.col("span")).select(*fields, F.lit(True).alias("own"))
    # A turn can be history only in the windows of the next few slots, so an equality join finds them.
    low, high = F.floor(F.col("end") / F.col("slot_size")), F.floor((F.col("start") + history) / F.col("slot_size"))
    ahead = placed.filter(~F.col("system") & (F.col("end") - F.col("start") <= history)).withColumn("at", F.explode(F.sequence(2 * low, 2 * F.greatest(low, high) + 1)))
    repeated = ahead.join(spans, same & (F.col("at") == F.col("s"))).filter((F.col("end") <= F.col("begin")) & (F.col("start") >= F.col("begin") - history)).select(*fields, F.lit(False).alias("own"))
    system = placed.filter("system").select("conv_id", "position", "role", "text")
    leading = system.join(spans, same).select("conv_id", F.col("s").alias("at"), "position", "role", "text", (F.col("begin") == 0).alias("own"))
    grouped = own.unionByName(repeated).unionByName(leading).groupBy("conv_id", "at").agg(F.array_sort(F.collect_list(F.struct("position", "own", "role", "text"))).alias("turns"))
    head = lambda t: F.concat(F.lit("<s>["), escaped(t["role"]), F.lit("]\n"))
    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), escaped(t["text"]).alias("body"), (t["own"] & (t["role"] == "assistant")).alias("target")))
    grouped = grouped.withColumn("n_context", F.size(F.filter("turns", lambda t: ~t["own"]))).withColumn("pieces", pieces)
    walked = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["head"]) + F.length(p["body"]) + 5).alias("at"),
            F.when(p["target"], F.array_append(a["loss"], F.struct((a["at"] + F.length(p["head"])).alias("start"), (a["at"] + F.length(p["head"]) + F.length(p["body"])).alias("end")))).otherwise(a["loss"]).alias("loss"),
        ),
    )
    formatted = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("</s>\n"))), "")
    return grouped.select("conv_id", F.col("at").alias("span"), "n_context", formatted.alias("formatted"), walked["loss"].alias("loss"))


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a window, unescaped."""
    out, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn begins at {at}")
        out.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from windows() alone.

    A conversation's windows pass through one task in order, one at a time; only running digests are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        done: list[tuple] = []

        def result() -> tuple:
            turns, loss = state["turns"].hexdigest(), state["loss"].hexdigest()
            return (conv[0], state["n"], turns, state["chars"], loss, state["formatted"])

        for batch in batches:
            for row in batch.to_pylist():
                if state is None or conv != (row["conv_id"],):
                    if state is not None:
                        done.append(result())
                    conv, state = (row["conv_id"],), {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0}
                text = row["formatted"]
                state["formatted"] += len(text)
                for role, said in parse(text)[row["n_context"] :]:
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in row["loss"]:
                    target = unescape(text[span["start"] : span["end"]])
                    state["chars"] += len(target)
                    state["loss"].update(target.encode("utf-8", "surrogatepass"))
            if done:
                yield _arrow(done)
                done = []
        if state is not None:
            yield _arrow([result()])

    rows = formatted.withColumn("conv_id", F.col("conv_id").cast("long"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "span")
    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
