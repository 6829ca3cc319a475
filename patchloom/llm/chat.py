r"""Chat formatting as prefix trees.

Each turn is marked `<s>role\n` ... `</s>`; inside roles and texts a backslash goes before every
`\`, `<` and `[`, and in roles before every line break, so no control string such as `</s>` or `[INST]` can stand there, and taking the
backslashes out restores the text. Tokens are code points unless a tokenizer is given.

Conversations are sorted by the path of their turns, which is the depth-first order of the tree
that merges shared initial turns. In that order a conversation adds only the turns that it does
not share with the one before. A pack is a run of neighbours of bounded size and is one tree: its
tokens are emitted once, depth-first, each node with the position ids of its depth and with the
intervals of its ancestors' tokens, which are what it attends to besides itself. Sorting is by
range over (path, id), so a first turn, or a whole conversation, that a third of the rows share is
spread over many packs; a pack repeats the prefix it begins in.

Defined cases: rows are ordered by turn, then role, then text; null role or text is empty; a null
conversation id is one conversation; repeated rows are repeated turns; an empty table gives no
rows; other columns are not read; one conversation longer than a pack is a pack of its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

PACK_TOKENS = 65_536
LOSS_ROLE = "assistant"
PACK_SCHEMA = """pack_id string, tokens array<int>, position_ids array<int>, loss array<struct<start:int,stop:int>>,
nodes array<struct<start:int,stop:int,parent:int,depth:int,ancestors:array<struct<start:int,stop:int>>>>, leaves array<struct<conv_id:long,node:int>>"""


def escape(text: str) -> str:
    return re.sub(r"([\\<\[])", r"\\\1", text)


def escape_role(role: str) -> str:
    """A role ends at its line break, so those inside it are escaped as well."""
    return re.sub(r"([\\<\[\n])", r"\\\1", role)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and the span of its loss, empty but for the assistant."""
    head, body = f"<s>{escape_role(role)}\n", escape(text)
    return f"{head}{body}</s>", len(head), len(head) + len(body) if role == LOSS_ROLE else len(head)


TURN_RE = re.compile(r"<s>((?:[^\\<\n]|\\.)*)\n((?:[^\\<]|\\.)*)</s>", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in TURN_RE.finditer(formatted)]


def conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turns (role, text in order), path: digests of the turns so far, which sort as the tree does."""
    role = F.coalesce(F.col(role_col), F.lit("")).alias("role")
    turn = F.struct(F.col(turn_col).alias("turn"), role, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = rows.groupBy(F.col(conv_col).cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    turns = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return own.select("conv_id", turns.alias("turns")).withColumn("path", F.transform("turns", lambda x: F.unhex(F.substring(F.md5(F.concat_ws("\n", F.length(x["role"]).cast("string"), x["role"], x["text"])), 1, 16))))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32)


def pack(convs: DataFrame, pack_tokens: int = PACK_TOKENS, encode: Callable[[str], list[int]] | None = None) -> DataFrame:
    """Prefix trees of conversations, PACK_SCHEMA. encode must map concatenated pieces to concatenated tokens."""
    code = (lambda s: np.asarray(encode(s), np.int32)) if encode else code_points

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial, size = None, 0, 0
        tokens: list[np.ndarray] = []
        pos: list[np.ndarray] = []
        loss: list = []
        nodes: list = []
        ends: list[int] = []  # of each node, the position after its last
        leaves: list = []
        stack: list = []  # (turn, node) from the root to where the last conversation ended
        span = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
        node_t = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("ancestors", pa.list_(span))])
        schema = pa.schema([("pack_id", pa.string()), ("tokens", pa.list_(pa.int32())), ("position_ids", pa.list_(pa.int32())), ("loss", pa.list_(span)), ("nodes", pa.list_(node_t)), ("leaves", pa.list_(pa.struct([("conv_id", pa.int64()), ("node", pa.int32())])))])

        def out() -> pa.RecordBatch:
            whole = lambda parts: pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *parts])))
            rest = [pa.array([x], schema.field(n).type) for n, x in (("loss", loss), ("nodes", nodes), ("leaves", leaves))]
            return pa.RecordBatch.from_arrays([pa.array([f"{part}-{serial}"]), whole(tokens), whole(pos), *rest], schema=schema)

        for b in batches:
            for i in range(b.num_rows):
                conv, turns, part = b.column(0)[i].as_py(), [(t["role"], t["text"]) for t in b.column(1)[i].as_py()], b.column(2)[i].as_py()
                if leaves and size >= pack_tokens:
                    yield out()
                    serial += 1
                    tokens, pos, loss, nodes, ends, leaves, stack, size = [], [], [], [], [], [], [], 0
                shared = 0
                while shared < min(len(stack), len(turns)) and stack[shared][0] == turns[shared]:
                    shared += 1
                del stack[shared:]
                for turn in turns[shared:]:
                    text, a, z = render(*turn)
                    pre, mid, post = code(text[:a]), code(text[a:z]), code(text[z:])
                    start, up = size, nodes[stack[-1][1]] if stack else None
                    at = ends[stack[-1][1]] if stack else 0
                    size += len(pre) + len(mid) + len(post)
                    tokens += [pre, mid, post]
                    pos.append(np.arange(at, at + size - start, dtype=np.int32))
                    if len(mid):
                        loss.append({"start": start + len(pre), "stop": start + len(pre) + len(mid)})
                    above = up["ancestors"] + [{"start": up["start"], "stop": up["stop"]}] if up else []
                    if len(above) > 1 and above[-2]["stop"] == above[-1]["start"]:
                        above = above[:-2] + [{"start": above[-2]["start"], "stop": above[-1]["stop"]}]
                    nodes.append({"start": start, "stop": size, "parent": stack[-1][1] if stack else -1, "depth": len(stack), "ancestors": above})
                    ends.append(at + size - start)
                    stack.append((turn, len(nodes) - 1))
                leaves.append({"conv_id": conv, "node": stack[-1][1] if stack else -1})
        if leaves:
            yield out()

    spread = convs.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    return spread.select("conv_id", "turns", F.spark_partition_id().alias("part")).mapInArrow(run, PACK_SCHEMA)


DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(packs: DataFrame) -> DataFrame:
    """Each conversation restored from its leaf's attention intervals; tokens are code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, tokens in zip(b.select(["loss", "nodes", "leaves"]).to_pylist(), b.column("tokens"), strict=True):
                text, rows = tokens.values.to_numpy().tobytes().decode("utf-32-le", "surrogatepass"), []
                starts = {x["start"]: x["stop"] for x in p["loss"]}
                by_start = sorted(starts)
                for leaf in p["leaves"]:
                    node = p["nodes"][leaf["node"]] if leaf["node"] >= 0 else {"ancestors": [], "start": 0, "stop": 0}
                    spans = [(s["start"], s["stop"]) for s in node["ancestors"]] + [(node["start"], node["stop"])]
                    formatted = "".join(text[a:z] for a, z in spans)
                    masked = _inside(spans, by_start, starts)
                    said = "".join(unescape(text[a:z]) for a, z in masked)
                    turns = parse(formatted)
                    told = "".join(f"{r}\n{t}\n" for r, t in turns)
                    rows.append((leaf["conv_id"], len(turns), _sha(told), len(said), _sha(said), len(formatted)))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f.split()[0] for f in DIGEST_SCHEMA.split(", ")])

    return packs.mapInArrow(run, DIGEST_SCHEMA)


def _inside(spans: list[tuple[int, int]], by_start: list[int], stops: dict[int, int]) -> list[tuple[int, int]]:
    from bisect import bisect_left

    found = []
    for a, z in spans:
        for s in by_start[bisect_left(by_start, a) : bisect_left(by_start, z)]:
            found.append((s, stops[s]))
    return found


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    own = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{hard}'), (-1L, 1L, 'assistant', '{hard}') AS t(conv_id, turn, role, text)")
    return read_back(pack(conversations(rows.unionByName(own))))


OP8_SQL = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(3 + length(regexp_replace(role, '([\\<\[\n])', '\\\1', 'g')) + 1 + length(regexp_replace(text, '([\\<\[])', '\\\1', 'g')) + 4)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""
