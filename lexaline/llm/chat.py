"""Chat formatting at token level.

Every turn becomes ``<|turn|>role<|body|>text<|end|>``. The three marks are reserved ids, spliced between the separately
encoded role and text, so no text can form one. In the text form of the output, control strings inside roles and texts
are escaped: ``<``, any number of backslashes and ``|`` get one backslash more, which unescaping takes away again. The
loss mask is the running sum of +1 after ``<|body|>`` and -1 at ``<|end|>`` of assistant turns.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Marks in the order of their reserved ids, which follow the tokenizer's own.
MARKS = ("<|turn|>", "<|body|>", "<|end|>")
ASSISTANT = "assistant"

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


_loaded: dict[str, tuple] = {}


def _tokenizer(path: str) -> tuple:
    """(tokenizer, id of the first mark) of a file, read once by each Python worker."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.encode_special_tokens = True
        _loaded[path] = made, made.get_vocab_size(with_added_tokens=True)
    return _loaded[path]


def formatted_turn(role: str, text: str) -> str:
    return f"{MARKS[0]}{escape(role)}{MARKS[1]}{escape(text)}{MARKS[2]}"


def assemble(role_ids: list[int], text_ids: list[int], mark: int, learn: bool) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask) of one turn from its encoded segments."""
    ids = np.array([mark, *role_ids, mark + 1, *text_ids, mark + 2], np.int32)
    delta = np.zeros(len(ids), np.int8)
    if learn:
        delta[len(role_ids) + 2] += 1
        delta[-1] -= 1
    return ids, np.cumsum(delta, dtype=np.int8)


def format_turns(rows: DataFrame, path: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv, nth, token_start, char_start, text, input_ids, loss_mask), one for each turn.

    The conversation is the concatenation of its turns by ``nth``, which counts from 0; the starts are prefix sums over
    it, so no task gathers a conversation. Turns are ordered by number (null first), then role and text; null roles and
    texts count as empty; null conversation ids are one conversation. Other columns are ignored.
    """

    @F.pandas_udf("text string, input_ids array<int>, loss_mask array<tinyint>")
    def encoded(roles: pd.Series, texts: pd.Series) -> pd.DataFrame:
        tokenizer, mark = _tokenizer(path)
        role_ids = {r: tokenizer.encode(escape(r), add_special_tokens=False).ids for r in set(roles)}
        text_ids = [e.ids for e in tokenizer.encode_batch([escape(t) for t in texts], add_special_tokens=False)]
        made = [assemble(role_ids[r], ids, mark, r == ASSISTANT) for r, ids in zip(roles, text_ids)]
        return pd.DataFrame({"text": [formatted_turn(r, t) for r, t in zip(roles, texts)], "input_ids": [m[0] for m in made], "loss_mask": [m[1] for m in made]})

    plain = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("raw"))
    turns = plain.withColumn("t", encoded("role", "raw")).select("conv", "turn", "role", "raw", "t.*")
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "raw")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return turns.select(
        F.col("conv").alias(conv_col),
        (F.row_number().over(order) - 1).cast("long").alias("nth"),
        F.coalesce(F.sum(F.size("input_ids").cast("long")).over(before), F.lit(0)).alias("token_start"),
        F.coalesce(F.sum(F.length("text").cast("long")).over(before), F.lit(0)).alias("char_start"),
        "text",
        "input_ids",
        "loss_mask",
    )


def conversations(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Rows (conv, text, input_ids, loss_mask), one for each conversation; for conversations that one row can hold."""
    one = turns.groupBy(conv_col).agg(F.array_sort(F.collect_list(F.struct("nth", "text", "input_ids", "loss_mask"))).alias("t"))
    return one.select(conv_col, F.array_join("t.text", "").alias("text"), F.flatten("t.input_ids").alias("input_ids"), F.flatten("t.loss_mask").alias("loss_mask"))


def read_turn(tokenizer, mark: int, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str]:
    """(role, text, text under the loss mask) of one turn's ids, unescaped."""
    body, end = int(np.flatnonzero(ids == mark + 1)[0]), len(ids) - 1
    if ids[0] != mark or ids[end] != mark + 2:
        raise ValueError("a turn must start and end with its marks")
    role, text, loss = (tokenizer.decode(part.tolist(), skip_special_tokens=False) for part in (ids[1:body], ids[body + 1 : end], ids[mask == 1]))
    return unescape(role), unescape(text), unescape(loss)


_DIGEST = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(turns: DataFrame, path: str, conv_col: str = "conv_id") -> DataFrame:
    """Rows (conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) read from what format_turns() made.

    The turns of a conversation stream through its task in order; only the state of the digests is held.
    """
    kind = turns.schema[conv_col].dataType.simpleString()
    ordered = turns.repartition(F.col(conv_col)).sortWithinPartitions(conv_col, "nth").select(conv_col, "input_ids", "loss_mask", F.length("text").alias("chars"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, mark = _tokenizer(path)
        state: list | None = None

        def row(s: list) -> tuple:
            return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

        for batch in batches:
            done = []
            for conv, ids, mask, chars in zip(*(batch.column(k) for k in range(4))):
                conv = conv.as_py()
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(row(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, loss = read_turn(tokenizer, mark, ids.values.to_numpy(), mask.values.to_numpy())
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "replace"))
                state[3] += len(loss)
                state[4].update(loss.encode("utf-8", "replace"))
                state[5] += chars.as_py()
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*[row(state)]), types)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    names = [conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [to_arrow_type(turns.schema[conv_col].dataType), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return ordered.mapInArrow(digest, f"{conv_col} {kind}, {_DIGEST}")
