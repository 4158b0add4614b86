"""Chat formatting in token-budgeted windows.

Turns are written as `<|im_start|>role`, newline, text, `<|im_end|>`, newline. Control strings inside
roles and texts are broken by a backslash after their first character and backslashes are doubled, so
no text can fake a marker and the original comes back exactly. Prefix sums of the turns' token counts
choose windows that begin and end between turns. Each window repeats the system turn and, within a
smaller budget, the turns just before it; the loss mask covers an assistant text only where it is new.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import small_batches, table

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that chat templates give a meaning.
CONTROL = (START, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
TURN = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\.)*)\n(.*?)<\|im_end\|>\n", re.S)
_WINDOWS = [("conv_id", None), ("window", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), ("first_turn", pa.int64()), ("n_repeated", pa.int64()), ("n_turns", pa.int64()), ("n_tokens", pa.int64())]


def escape(text: str, role: bool = False) -> str:
    text = text.replace("\\", "\\\\")
    for c in CONTROL:
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text.replace("\n", "\\\n") if role else text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn as text, and where its content begins and ends."""
    head = f"{START}{escape(role, True)}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse(window: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a window."""
    out, at = [], 0
    for m in TURN.finditer(window):
        if m.start() != at:
            break
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(window):
        raise ValueError("not a formatted window")
    return out


def _counted(tokenizer: str):
    """Adds the number of tokens of each rendered turn."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        for b in batches:
            texts = [render(r, x)[0] for r, x in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True)]
            n = pa.array([len(x.ids) for x in t.encode_batch_fast(texts, add_special_tokens=False)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, n], [*b.schema.names, "n_tokens"])

    return run


def _windows(budget: int, history: int):
    """Windows of sorted turns. Holds one window's turns at a time, however long a conversation is."""

    def run(batches):
        conv, begun = None, False
        out: list[tuple] = []
        system: tuple | None = None
        now: list[tuple] = []
        past: deque = deque()
        spent = kept = past_spent = turn = window = 0

        def close():
            nonlocal window
            repeated = ([system] if system and window else []) + list(past)
            text, loss = [], []
            at = 0
            for k, (rendered, s, e, target, _) in enumerate([*repeated, *now]):
                if target and k >= len(repeated):
                    loss.append({"s": at + s, "e": at + e})
                text.append(rendered)
                at += len(rendered)
            row = (conv, window, "".join(text), loss, turn - len(now), len(repeated), len(now), sum(x[4] for x in [*repeated, *now]))
            window += 1
            return row

        def batch():
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k or kind) for c, (_, k) in zip(cols, _WINDOWS, strict=True)], [n for n, _ in _WINDOWS])

        kind = None
        for b in batches:
            kind = b.schema.field("conv_id").type
            for c, role, text, n in zip(*(b.column(x).to_pylist() for x in ("conv_id", "role", "text", "n_tokens")), strict=True):
                if not begun or c != conv:
                    if now:
                        out.append(close())
                    conv, begun, system, now, turn, window, spent, past_spent, kept = c, True, None, [], 0, 0, 0, 0, 0
                    past.clear()
                x = (*render(role, text), role == "assistant", n)
                if now and kept + past_spent + spent + n > budget:
                    out.append(close())
                    # the last turns that fit, unless the system turn, which is repeated anyway
                    for y in now:
                        if y is not system:
                            past.append(y)
                            past_spent += y[4]
                    now, spent = [], 0
                    kept = system[4] if system else 0
                    while past and (past_spent > history or kept + past_spent + n > budget):
                        past_spent -= past.popleft()[4]
                if turn == 0 and role == "system":
                    system = x
                now.append(x)
                spent += n
                turn += 1
                if len(out) >= 500:
                    yield batch()
        if now:
            out.append(close())
        if out:
            yield batch()

    return run


def windows(conversations: DataFrame, budget: int = 1024, history: int = 256, tokenizer: str | None = None) -> DataFrame:
    """(conv_id, window, text, loss, first_turn, n_repeated, n_turns, n_tokens), sorted by window in each conversation.

    conversations has conv_id, turn, role and text; turns are ordered by turn, then role and text. A
    window holds n_repeated turns again (the system turn first, if the conversation begins with one) and
    n_turns new ones from first_turn on; together at most `budget` tokens, except where one new turn and
    the system turn alone exceed it. loss lists the code point ranges of new assistant texts in `text`.

    Null roles and texts: empty. Null conv_id: a conversation of its own; null turns come first. Repeated
    rows: repeated turns. Empty texts keep their turn. Other columns are not looked at. An empty table
    gives an empty table. A conversation is streamed through one task in order, since its digests need
    that; a task holds only the window it is at, so memory does not grow with a conversation.
    """
    if tokenizer is None:
        import public_tokenizers as P

        tokenizer = P.path("byte_bpe_50k.json")
    small_batches(conversations.sparkSession)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")))
    kind = rows.schema["conv_id"].dataType.simpleString()
    rows = rows.mapInArrow(_counted(tokenizer), f"conv_id {kind}, turn long, role string, text string, n_tokens long")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(_windows(budget, history), f"conv_id {kind}, window long, text string, loss array<struct<s:long,e:long>>, first_turn long, n_repeated long, n_turns long, n_tokens long")


def _digests(batches):
    """Reads windows back, in order, and digests each conversation's new turns and masked texts."""
    conv, begun = None, False
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    kinds = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    turns = loss = None
    n = chars = formatted = count = 0
    out = []

    def batch():
        cols = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k or kind) for c, k in zip(cols, kinds, strict=True)], names)

    kind = None
    for b in batches:
        kind = b.schema.field("conv_id").type
        for c, text, spans, repeated in zip(*(b.column(x).to_pylist() for x in ("conv_id", "text", "loss", "n_repeated")), strict=True):
            if not begun or c != conv:
                if begun:
                    out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, count))
                conv, begun, turns, loss, n, chars, formatted, count = c, True, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
            for role, said in parse(text)[repeated:]:
                turns.update(f"{role}\n{said}\n".encode())
                n += 1
            for x in spans:
                said = unescape(text[x["s"] : x["e"]])
                loss.update(said.encode())
                chars += len(said)
            formatted += len(text)
            count += 1
            if len(out) >= 5000:
                yield batch()
    if begun:
        out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, count))
    if out:
        yield batch()


def read_back(formatted: DataFrame) -> DataFrame:
    """A row for each conversation of `windows`' result: what its windows and masks hold."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(_digests, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7, whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(windows(rows))
