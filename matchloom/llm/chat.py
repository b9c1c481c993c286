"""Chat formatting by assembly of separately encoded segments.

Every role and every text is escaped and encoded by itself; turn marks are reserved ids
above the vocabulary, spliced between segments, so no content can produce one.  The
formatted text shows the marks as control strings; where a text holds one, or the
escape character, it is escaped reversibly.  Positions are prefix sums of segment lengths, and
the loss mask is the prefix sum of a one at every start and a minus one at every end of a loss
segment.  Reading back decodes ids and mask alone, a block of turns at a time, by gathers.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .packing import encoder

#: Fixed values of the template: control strings in the order of their reserved ids.
MARKS = ("<s>", "[INST]", "[/INST]", "</s>")
BEGIN, HEAD, BODY, END = range(4)
ESCAPE = "␛"
_CONTROL = re.compile("|".join(map(re.escape, MARKS)))
_ESCAPED = re.compile(ESCAPE + "(" + ESCAPE + "?)")
#: Turns that are encoded or decoded together.
BLOCK = 1000


def escape(text: str) -> str:
    """Doubles the escape character and breaks every control string after its first character."""
    text = text.replace(ESCAPE, ESCAPE * 2)
    while _CONTROL.search(text):
        text = _CONTROL.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text)
    return text


def unescape(text: str) -> str:
    """The inverse of :func:`escape`."""
    return _ESCAPED.sub(lambda m: m[1], text)


class Vocabulary:
    """Bytes of every id, the marks' included, in one array."""

    def __init__(self, path: str):
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
        known = encoder(path).tokenizer.get_vocab()
        #: The id of the first mark.
        self.first = max(known.values()) + 1
        each = [b""] * self.first + [m.encode() for m in MARKS]
        for token, i in known.items():
            each[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.size = np.fromiter(map(len, each), np.int64, len(each))
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(each), np.uint8)

    def decoded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes of the ids in a row, and the place where each id's bytes begin (and where the last ends)."""
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[ids] - ends + size, size)
        return self.bytes[at], np.concatenate(([0], ends))


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """One table for a worker process."""
    return Vocabulary(path)


def decode(ids: list[int], path: str) -> str:
    """Formatted text of ids."""
    return vocabulary(path).decoded(np.array(ids, np.int64))[0].tobytes().decode("utf-8")


_SEGMENTS = "conv_id long, turn long, ids binary, mask binary, length long, loss_start long, loss_length long"


def segments(turns: DataFrame, tokenizer: str, loss_role: str = "assistant") -> DataFrame:
    """One row per turn of (conv_id, turn, role, text): conv_id, turn, ids, mask, length, loss_start, loss_length.

    ``<s> [INST] role [/INST] text </s>`` is a turn; ids are 32-bit integers, marks follow the
    vocabulary.  mask has a bit for every id, set where it belongs to the text of a ``loss_role`` turn,
    which begins at id loss_start.  Defined cases: null roles and texts count as empty; null ids
    and turns stay null; equal turns or repeated rows are rows of their own; an empty table has none; other columns
    play no part, whatever their names.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, first = encoder(tokenizer), vocabulary(tokenizer).first
        mark = [np.array([first + i], "<u4") for i in range(len(MARKS))]
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK):
                part = pdf.iloc[at : at + BLOCK]
                pieces, loss = [], []
                for role, text in zip(part["role"], part["text"], strict=True):
                    head, body = (np.frombuffer(encode(escape(x or "")), "<u4") for x in (role, text))
                    pieces += [mark[BEGIN], mark[HEAD], head, mark[BODY], body, mark[END]]
                    loss.append(role == loss_role)
                size = np.fromiter(map(len, pieces), np.int64, len(pieces))
                ends = np.cumsum(size)
                begins, bodies = (ends - size).reshape(-1, 6)[:, 0], np.arange(4, len(pieces), 6)[np.array(loss, bool)]
                step = np.zeros(ends[-1] + 1, np.int64)
                np.add.at(step, (ends - size)[bodies], 1)
                np.add.at(step, ends[bodies], -1)
                flat, mask = np.concatenate(pieces), np.cumsum(step)[:-1].astype(bool)
                lasts = ends.reshape(-1, 6)[:, 5]
                out = pd.DataFrame(
                    {
                        "ids": [flat[a:b].tobytes() for a, b in zip(begins, lasts, strict=True)],
                        "mask": [np.packbits(mask[a:b]).tobytes() for a, b in zip(begins, lasts, strict=True)],
                        "length": lasts - begins,
                        "loss_start": (ends - size).reshape(-1, 6)[:, 4] - begins,
                        "loss_length": np.add.reduceat(mask.astype(np.int64), begins),
                    }
                )
                for c in ("conv_id", "turn"):
                    out[c] = pd.array(part[c], "Int64")
                yield out[[c.split()[0] for c in _SEGMENTS.split(", ")]]

    return turns.select("conv_id", "turn", "role", "text").mapInPandas(run, _SEGMENTS)


def read_back(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """Per conversation, from ids and masks alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, loss_tokens.

    Rows are put in order (turn, then ids) within partitions and streamed, so a conversation of any
    length needs the memory of one batch: digests and counts are carried on.  A digest runs through a
    conversation in order, so one conversation is one task.  Turns with equal numbers come in the order of their ids,
    null numbers first; an empty table has no conversations.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = vocabulary(tokenizer)
        state: dict | None = None

        def result(s: dict) -> tuple:
            return (s["id"], s["turns"], s["all"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"], s["tokens"], s["masked"])

        def text(raw: np.ndarray) -> str:
            return unescape(raw.tobytes().decode("utf-8"))

        for pdf in batches:
            done = []
            for at in range(0, len(pdf), BLOCK):
                part = pdf.iloc[at : at + BLOCK]
                each = [np.frombuffer(x, "<u4") for x in part["ids"]]
                rows = np.concatenate(([0], np.cumsum(np.fromiter(map(len, each), np.int64, len(each)))))
                ids = np.concatenate(each).astype(np.int64)
                mask = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(x)) for m, x in zip(part["mask"], each, strict=True)])
                raw, place = words.decoded(ids)
                marks = np.flatnonzero(ids >= words.first)
                if len(marks) != 4 * len(each) or not ((ids[marks] - words.first).reshape(-1, 4) == [BEGIN, HEAD, BODY, END]).all():
                    raise ValueError("a turn isn't framed by its four marks")
                marks = marks.reshape(-1, 4)
                size = np.diff(place)
                under = raw[np.repeat(mask.astype(bool), size)]
                loss_at = np.concatenate(([0], np.cumsum(size * mask)))[rows]
                chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[place[rows]]
                masked = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))[rows]
                for i, conv in enumerate(part["conv_id"]):
                    conv = None if pd.isna(conv) else int(conv)
                    if state is None or state["id"] != conv:
                        if state is not None:
                            done.append(result(state))
                        state = {"id": conv, "turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "tokens": 0, "masked": 0}
                    role, body = (text(raw[place[a + 1] : place[b]]) for a, b in zip(marks[i, 1:3], marks[i, 2:], strict=True))
                    loss = text(under[loss_at[i] : loss_at[i + 1]])
                    state["turns"] += 1
                    state["all"].update(f"{role}\n{body}\n".encode())
                    state["loss"].update(loss.encode())
                    state["loss_chars"] += len(loss)
                    state["chars"] += int(chars[i + 1] - chars[i])
                    state["tokens"] += len(each[i])
                    state["masked"] += int(masked[i + 1] - masked[i])
            yield _digests(done)
        if state is not None:
            yield _digests([result(state)])

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "ids")
    return ordered.select("conv_id", "ids", "mask").mapInPandas(
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long",
    )


def _digests(rows: list[tuple]) -> pd.DataFrame:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"]
    out = pd.DataFrame(rows, columns=names)
    return out.assign(conv_id=pd.array(out["conv_id"], "Int64"))


def conversations(formatted: DataFrame) -> DataFrame:
    """(conv_id, ids, loss_spans) of whole conversations: token arrays, and the (start, length) of every loss part, in order.

    Positions are prefix sums of the turns' lengths.  A conversation is one row here, so this form is for
    such as fit into a training sequence; :func:`segments` rows have no such bound.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "ids").rowsBetween(Window.unboundedPreceding, -1)
    placed = formatted.withColumn("start", F.coalesce(F.sum("length").over(order), F.lit(0)) + F.col("loss_start"))
    span = F.when(F.col("loss_length") > 0, F.struct("start", F.col("loss_length").alias("length")))
    return placed.groupBy("conv_id").agg(
        F.expr("listagg(ids, x'') WITHIN GROUP (ORDER BY start - loss_start, turn)").alias("ids"), F.sort_array(F.collect_list(span)).alias("loss_spans")
    )
