"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and
only that reply trainable.  Turns after a conversation's last reply are kept in one more
example without a target.  The turns of a conversation come together by one shuffle and a
sort that Spark spills; a task then holds no more than the text of the example it is
making, never a list of a group's rows.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn.  Control strings inside
texts and roles get a backslash after their first character and backslashes are doubled,
so that no text can pose as a mark, and ``unescape`` gives the text back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that chat templates in use give a meaning to (fixed values).
CONTROLS = (START, END, "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.S)
#: Bytes of text after which a task hands on what it has made.
BATCH_BYTES = 4_000_000


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def escape_role(role: str) -> str:
    """As a text; a line end, which ends a role, becomes a backslash and ``n``."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The roles and texts of a formatted example."""
    return [(unescape_role(r), unescape(t)) for r, t in _TURN.findall(formatted)]


EXAMPLES = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("target", T.LongType()),
        T.StructField("n_turns", T.LongType(), False),
        T.StructField("formatted", T.StringType(), False),
        T.StructField("loss_start", T.LongType(), False),
        T.StructField("loss_end", T.LongType(), False),
    ]
)


class _Out:
    """Rows on their way out of a task, handed on in bounded batches."""

    def __init__(self, schema: T.StructType):
        self.arrow, self.rows, self.held = to_arrow_schema(schema), [], 0

    def add(self, *row) -> None:
        self.rows.append(row)
        self.held += 100 + sum(len(x) for x in row if isinstance(x, str))

    def take(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if self.rows and self.held >= least:
            cols = [pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.arrow)]
            yield pa.RecordBatch.from_arrays(cols, schema=self.arrow)
            self.rows, self.held = [], 0


def prefix_targets(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per assistant turn of ``turns``: conv_id, target (the turn's number),
    n_turns (turns in the example), formatted, and the code points loss_start to loss_end
    (end exclusive) of the trainable reply in it.  Turns after the last reply make one
    row with a null target and an empty mask, so that no turn is lost.

    Turns are ordered by number, null first; equal numbers by role, then text, and all
    are kept, as are repeated rows.  Null texts and roles are empty ones.  A null
    conversation is one like any other.  Other columns are not handed on.  An empty table
    gives no examples.  An example's text holds its whole context, so a task holds one
    conversation's text.
    """
    rows = turns.select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(EXAMPLES)
        now, context, size, n, open_turns = object(), [], 0, 0, 0

        def rest() -> None:
            if open_turns:
                out.add(now, None, n, "".join(context), size, size)

        for batch in batches:
            for c, k, r, t in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if c != now:
                    rest()
                    now, context, size, n, open_turns = c, [], 0, 0, 0
                head, body = f"{START}{escape_role(r)}\n", escape(t)
                n += 1
                if len(context) > 64:
                    context = ["".join(context)]
                context += (head, body, f"{END}\n")
                if r == "assistant":
                    begin = size + len(head)
                    out.add(c, k, n, "".join(context), begin, begin + len(body))
                    open_turns = 0
                else:
                    open_turns += 1
                size += len(head) + len(body) + len(END) + 1
                yield from out.take(BATCH_BYTES)
        rest()
        yield from out.take()

    return rows.mapInArrow(run, EXAMPLES)


DIGESTS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("n_turns", T.LongType(), False),
        T.StructField("turns_sha256", T.StringType(), False),
        T.StructField("loss_chars", T.LongType(), False),
        T.StructField("loss_sha256", T.StringType(), False),
        T.StructField("formatted_chars", T.LongType(), False),
        T.StructField("n_examples", T.LongType(), False),
    ]
)


def conversation_digests(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation say, read back from their text and masks.

    ``examples`` must be the direct output of ``prefix_targets``, in which a
    conversation's examples follow each other in one partition, the longest last; only
    that one is held.  formatted_chars is the sum over the conversation's examples.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(DIGESTS)
        now, last, loss, chars, total, made, seen = object(), "", hashlib.sha256(), 0, 0, 0, 0

        def close() -> None:
            if made:
                turns = read_turns(last)
                if len(turns) != seen:
                    raise ValueError(f"conversation {now}: {len(turns)} turns read back of {seen}")
                digest = hashlib.sha256()
                for r, t in turns:
                    digest.update(f"{r}\n{t}\n".encode())
                out.add(now, len(turns), digest.hexdigest(), chars, loss.hexdigest(), total, made)

        for batch in batches:
            for c, n, text, a, b in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))):
                if c != now:
                    close()
                    now, loss, chars, total, made, seen = c, hashlib.sha256(), 0, 0, 0, 0
                if n < seen:
                    raise ValueError(f"conversation {c}: examples out of order")
                reply = unescape(text[a:b])
                loss.update(reply.encode())
                chars, total, made, seen, last = chars + len(reply), total + len(text), made + 1, n, text
                yield from out.take(BATCH_BYTES)
        close()
        yield from out.take()

    return examples.mapInArrow(run, DIGESTS)
