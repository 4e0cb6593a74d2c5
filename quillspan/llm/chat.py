"""Chat formatting over a prefix tree of conversations.

A turn is written as ``### role: text</turn>`` and a line end; ``\\``, ``#`` and ``<`` inside texts
(and ``:`` in roles) get a backslash before them, so no text can hold a control string. A node of
the tree is a turn with all turns before it, named by a chained hash; conversations with the same
initial turns share their nodes. Nodes are sorted by path, which is depth-first order, and each
emits its tokens once, into the stretch of its partition. A node carries the position id of its first
token (all tokens of its ancestors come before it) and the intervals of the stream that it may
attend to: its ancestors' and its own.

Turns are streamed in order through each task, so a conversation of any length needs no more memory
than its hashers; a path holds sixteen bytes a turn. A shared node is one row however many share it.

Cases: null texts and roles are empty ones; turns with one number are ordered by role, then text, a
repeated row is a further turn; a null turn number comes first, a null conv_id is a conversation; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

OPEN, BETWEEN, CLOSE, LEARNED = "### ", ": ", "</turn>\n", "assistant"
_MARK, _BACK = re.compile(r"[\\#<]"), re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _MARK.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def _header(role: str) -> str:
    return OPEN + escape(role).replace(":", "\\:") + BETWEEN


_TOK: dict = {}


def _tokenizer(path: str):
    if path not in _TOK:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _TOK[path] = Tokenizer.from_file(path)
        _TOK[path].encode_special_tokens = True
    return _TOK[path]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, node, path, role, text: every turn with the name and path of its node."""

    def chained(batches):
        conv, path, depth, begun = None, b"", 0, False
        for b in batches:
            rows = []
            for c, role, text in zip(b["conv_id"].astype(object), b["role"], b["text"]):
                c = None if pd.isna(c) else int(c)
                if not begun or c != conv:
                    conv, path, depth, begun = c, b"", 0, True
                h = hashlib.sha256(path[-16:] + f"{len(role)}:{role}{text}".encode())
                path += h.digest()[:16]
                rows.append((c, depth, path[-16:], path, role, text))
                depth += 1
            out = pd.DataFrame(rows, columns=["conv_id", "depth", "node", "path", "role", "text"])
            yield out.astype({"conv_id": "Int64"})

    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    return rows.repartition("conv_id").sortWithinPartitions(*order).mapInPandas(chained, "conv_id long, depth int, node binary, path binary, role string, text string")


def tree(turned: DataFrame, tokenizer: str) -> DataFrame:
    """A row for each node: node, path, depth, role, ids (little-endian unsigned 32-bit), loss_start
    and loss_end (of the tokens to learn, within the node), chars, stretch, start, end, depth-first."""
    path = tokenizer

    def emitted(batches):
        from pyspark import TaskContext

        tok, at, part = _tokenizer(path), 0, TaskContext.get().partitionId()
        for b in batches:
            heads, bodies = [_header(r) for r in b["role"]], [escape(t) for t in b["text"]]
            enc = lambda x: [e.ids for e in tok.encode_batch(x, add_special_tokens=False)]
            close, rows = enc([CLOSE])[0], []
            for i, (h, t) in enumerate(zip(enc(heads), enc(bodies))):
                n = len(h) + len(t) + len(close)
                rows.append((np.array(h + t + close, "<u4").tobytes(), len(h), len(h) + len(t), len(heads[i]) + len(bodies[i]) + len(CLOSE), part, at, at + n))
                at += n
            out = pd.DataFrame(rows, columns=["ids", "loss_start", "loss_end", "chars", "stretch", "start", "end"])
            out.loc[b["role"].to_numpy() != LEARNED, ["loss_start", "loss_end"]] = 0
            for c in ("node", "path", "depth", "role"):
                out[c] = b[c].to_numpy()
            yield out

    nodes = turned.select("node", "path", "depth", "role", "text").dropDuplicates(["node"])
    return nodes.repartitionByRange("path").sortWithinPartitions("path").mapInPandas(emitted, "ids binary, loss_start int, loss_end int, chars long, stretch int, start long, end long, node binary, path binary, depth int, role string")


def attending(nodes: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """node, position (id of its first token), attends: array of struct(depth, stretch, start, end), root first.

    Of all nodes, or of those that asked names; a node's list is as long as its depth."""
    those = nodes if asked is None else nodes.join(asked.select("node").distinct(), "node", "left_semi")
    step = F.posexplode_outer(F.expr("transform(sequence(0, depth), i -> substring(path, 16 * i + 1, 16))")).alias("d", "up")
    ups = those.select("node", step).join(nodes.select(F.col("node").alias("up"), "stretch", "start", "end"), "up")
    got = ups.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("d", "stretch", "start", "end"))).alias("attends"))
    before = F.aggregate("attends", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    last = F.element_at("attends", -1)
    return got.select("node", (before - last["end"] + last["start"]).alias("position"), "attends")


def read_back(turned: DataFrame, nodes: DataFrame, tokenizer: str) -> DataFrame:
    """A row for each conversation, read from the tokens that its last node attends to."""
    leaves = turned.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node"))
    spans = leaves.join(attending(nodes, leaves), "node").select("conv_id", F.explode_outer("attends").alias("a")).select("conv_id", "a.*")
    tokens = spans.join(nodes.select("stretch", "start", "ids", "role", "loss_start", "loss_end"), ["stretch", "start"])
    path = tokenizer

    def read(batches):
        tok, now, begun = _tokenizer(path), None, False

        def row():
            return (now, n, turn_hash.hexdigest(), learned, loss_hash.hexdigest(), chars)

        for b in batches:
            rows = []
            ids = [np.frombuffer(x, "<u4") for x in b["ids"]]
            texts = tok.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)
            for c, text, x, lo, hi in zip(b["conv_id"].astype(object), texts, ids, b["loss_start"], b["loss_end"]):
                c = None if pd.isna(c) else int(c)
                if not begun or c != now:
                    if begun:
                        rows.append(row())
                    now, begun, n, learned, chars, turn_hash, loss_hash = c, True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                m = re.match(r"### ((?:\\.|[^\\:])*): (.*)</turn>\n\Z", text, re.S)
                turn_hash.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                n, chars = n + 1, chars + len(text)
                if hi > lo:
                    own = unescape(tok.decode(x[lo:hi].tolist(), skip_special_tokens=False))
                    learned += len(own)
                    loss_hash.update(own.encode())
            yield frame(rows)
        if begun:
            yield frame([row()])

    def frame(rows):
        return pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})

    tokens = tokens.select("conv_id", "d", "ids", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "d")
    return tokens.mapInPandas(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
