"""Chat formatting into prefix trees.

Conversations that begin with the same turns share those turns: a sequence holds a tree of turns depth first, each turn
once, with the position its tokens have within their conversation and, as attention intervals, the stretches of the
sequence that its ancestors take.  Tokens are code points of the formatted text.  A sequence is bounded: turns that very
many conversations begin with are trunks, sequences of their own, and sequences that go on from a trunk name it as their
ancestor, all of which their turns attend to.  So every shared turn stands once, however large a tree grows.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``.  Control strings inside roles and texts are escaped: a backslash and
a letter stand for each, and for the backslash itself, so texts read back as they were.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

START, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings of public chat templates.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>")
_CODES = {"\\": "\\", "\n": "n"} | {c: chr(ord("A") + i) for i, c in enumerate(CONTROL)}
_TEXTS = {code: text for text, code in _CODES.items()}
_IN_TEXT = re.compile("|".join(map(re.escape, ["\\", *CONTROL])))
_IN_ROLE = re.compile("|".join(map(re.escape, ["\\", "\n", *CONTROL])))
_CODE = re.compile(r"\\(.)", re.S)
LEARNED_ROLE = "assistant"
#: Turns that more different conversations than this begin with are a sequence of their own, which others continue.
MOST_IN_SEQUENCE = 512
#: Trunks, and characters of their texts, that are broadcast to the sequences that continue them; more are joined by shuffle.
MOST_TRUNKS_BROADCAST, MOST_TRUNK_CHARS = 100_000, 32_000_000


def escape(text: str, role: bool = False) -> str:
    return (_IN_ROLE if role else _IN_TEXT).sub(lambda m: "\\" + _CODES[m[0]], text)


def unescape(text: str) -> str:
    return _CODE.sub(lambda m: _TEXTS[m[1]], text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and where its text begins and ends."""
    head = f"{START}{escape(role, True)}\n"
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def parse_turn(formatted: str) -> tuple[str, str]:
    if not formatted.startswith(START) or not formatted.endswith(END):
        raise ValueError("not a formatted turn")
    role, _, text = formatted[len(START) : -len(END)].partition("\n")
    return unescape(role), unescape(text)


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Neighbouring intervals, in order, as one."""
    out: list[tuple[int, int]] = []
    for a, b in intervals:
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        elif b > a:
            out.append((a, b))
    return out


NODE = "struct<start:long,end:long,position:long,parent:int,role:string,loss_start:long,loss_end:long,attends:array<struct<start:long,end:long>>>"
#: ``position`` is that of the first turns; a node without parent continues the last node of ``ancestor``, if that is not null.
SEQUENCE_SCHEMA = f"sequence string, ancestor string, trunk boolean, position long, text string, nodes array<{NODE}>, leaves array<struct<path:string,node:int>>"
_NODE_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("position", pa.int64()), ("parent", pa.int32()), ("role", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("attends", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))
_LEAF_TYPE = pa.list_(pa.struct([("path", pa.string()), ("node", pa.int32())]))


def build_tree(conversations: list[tuple[str, list[tuple[str, str]]]], base: int = 0) -> tuple[str, list[tuple], list[tuple[str, int]]]:
    """(path, turns) in order of turns -> text, nodes and (path, last node) of each conversation; -1 for one without turns.

    In that order a conversation shares its longest common beginning with the one before, so one walk is depth first.
    Positions count from ``base``.
    """
    text, nodes, leaves, stack, size = [], [], [], [], 0
    for path, turns in conversations:
        shared = 0
        while shared < min(len(stack), len(turns)) and stack[shared][0] == turns[shared]:
            shared += 1
        del stack[shared:]
        for role, said in turns[shared:]:
            formatted, a, b = format_turn(role, said)
            start, end = size, size + len(formatted)
            parent = stack[-1][1] if stack else -1
            position = nodes[parent][2] + nodes[parent][1] - nodes[parent][0] if stack else base
            attends = merged([*((x, y) for x, y in nodes[parent][7]), (nodes[parent][0], nodes[parent][1])]) if stack else []
            learned = role == LEARNED_ROLE
            nodes.append((start, end, position, parent, role, start + a if learned else -1, start + b if learned else -1, attends))
            stack.append(((role, said), len(nodes) - 1))
            text.append(formatted)
            size = end
        leaves.append((path, stack[-1][1] if stack else -1))
    return "".join(text), nodes, leaves


def turns_of(conversations: DataFrame) -> DataFrame:
    """Rows by turn -> conv_id, roles, texts, d: digests of the turns, path: a digest of them all."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = rows.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    grouped = known.unionByName(rows.filter("conv_id IS NULL").select("conv_id", F.array(F.struct("turn", "role", "text")).alias("t")))
    each = lambda f: F.transform("t", f)
    parts = grouped.select("conv_id", each(lambda t: t["role"]).alias("roles"), each(lambda t: t["text"]).alias("texts"), each(lambda t: F.md5(F.concat(F.md5(t["role"]), F.md5(t["text"])))).alias("d"))
    return parts.withColumn("path", F.md5(F.array_join("d", ",")))


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, d) -> (path, depth, prefix): a digest of the first ``depth`` turns, for every depth."""
    for batch in batches:
        for path, d in zip(batch.column("path").to_pylist(), batch.column("d").to_pylist(), strict=True):
            upto, found = hashlib.md5(), []
            for turn in d:
                upto.update(turn.encode())
                found.append(upto.hexdigest())
            yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(d), pa.string()), "depth": pa.array(range(1, len(d) + 1), pa.int32()), "prefix": pa.array(found, pa.string())})


def trunks(paths: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(path, d) of different conversations -> where the conversations of large trees go, and the trunks.

    (path, sequence, ancestor, cut): the sequence holds the turns after the first ``cut``; sequence is null for a
    conversation that ends with its trunk.  (sequence, ancestor, cut, stop, path, leaf): a trunk holds the turns after
    ``cut`` up to ``stop`` of path, and leaf is the conversation that ends there, or null.  Beginnings that more than
    ``most`` conversations share are trunks, those that the same conversations share one trunk.  What goes on from a
    trunk is dealt by its next turn to sequences of about ``most`` conversations.
    """
    large = paths.groupBy(F.col("d")[0].alias("top")).count().filter(F.col("count") > most).select("top")
    inside = paths.join(large, F.col("d")[0] == F.col("top"), "left_semi")
    prefixes = common.materialize(inside.select("path", "d").mapInArrow(_prefixes, "path string, depth int, prefix string"), "prefixes")
    often = common.materialize(prefixes.groupBy("prefix").agg(F.count("*").alias("n")).filter(F.col("n") > most), "trunk-prefixes")
    few = often.count()
    shared = prefixes.join(common.broadcast_if_small(often, few, MOST_TRUNKS_BROADCAST), "prefix")
    runs = shared.groupBy("path", "n").agg(F.min("depth").alias("start"), F.max("depth").alias("stop"), F.min_by("prefix", "depth").alias("run"))
    # A conversation's runs in order; each run hangs on the one before.
    chain = runs.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "run"))).alias("c")).join(inside.select("path", F.size("d").alias("turns")), "path")
    chain = common.materialize(chain, "trunk-chains")
    each = chain.select("path", "turns", F.posexplode("c").alias("k", "r"), "c")
    before = F.when(F.col("k") > 0, F.concat(F.lit("trunk-"), F.try_element_at("c", F.col("k"))["run"]))
    held = each.select(F.concat(F.lit("trunk-"), "r.run").alias("sequence"), before.alias("ancestor"), (F.col("r.start") - 1).alias("cut"), F.col("r.stop").alias("stop"), "path", F.when(F.col("turns") == F.col("r.stop"), F.col("path")).alias("leaf"))
    of_trunk = held.groupBy("sequence").agg(*[F.first(c, True).alias(c) for c in ("ancestor", "cut", "stop")], F.min("path").alias("path"), F.max("leaf").alias("leaf"))
    last = F.element_at("c", -1)
    ends = chain.select("path", "turns", F.concat(F.lit("trunk-"), last["run"]).alias("ancestor"), last["stop"].alias("cut"))
    nexts = ends.filter("turns > cut").join(prefixes.withColumnRenamed("prefix", "next"), "path").filter(F.col("depth") == F.col("cut") + 1).select("path", "ancestor", "cut", "next")
    sizes = nexts.groupBy(F.col("ancestor").alias("_a")).agg(F.ceil(F.count("*") / most).alias("parts"))
    dealt = nexts.join(common.broadcast_if_small(sizes, few, MOST_TRUNKS_BROADCAST), F.col("ancestor") == F.col("_a"))
    dealt = dealt.select("path", F.concat_ws("/", "ancestor", F.pmod(F.xxhash64("next"), F.col("parts")).cast("string")).alias("sequence"), "ancestor", "cut")
    return dealt.unionByName(ends.filter("turns = cut").select("path", F.lit(None).cast("string").alias("sequence"), "ancestor", "cut")), of_trunk


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sequence, ancestor, trunk, cut, path, roles, texts) in order of sequence -> SEQUENCE_SCHEMA, one sequence held at a time."""
    out, size = [], 0

    def packed(rows):
        columns = list(zip(*rows, strict=True))
        kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string(), _NODE_TYPE, _LEAF_TYPE)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["sequence", "ancestor", "trunk", "position", "text", "nodes", "leaves"])

    for group in common.groups(batches, ["sequence"]):
        rows = group.to_pydict()
        cut = rows["cut"][0]
        turns = [list(zip(r, t, strict=True)) for r, t in zip(rows["roles"], rows["texts"], strict=True)]
        base = sum(len(format_turn(*t)[0]) for t in turns[0][:cut])
        listed = sorted(((t[cut:], p or "") for t, p in zip(turns, rows["path"], strict=True)), key=lambda x: x)
        text, nodes, leaves = build_tree([(p, t) for t, p in listed], base)
        made = [{"start": n[0], "end": n[1], "position": n[2], "parent": n[3], "role": n[4], "loss_start": n[5], "loss_end": n[6], "attends": [{"start": a, "end": b} for a, b in n[7]]} for n in nodes]
        out.append((rows["sequence"][0], rows["ancestor"][0], rows["trunk"][0], base, text, made, [{"path": p, "node": k} for p, k in leaves if p]))
        size += len(text)
        if size > 4_000_000:
            yield packed(out)
            out, size = [], 0
    if out:
        yield packed(out)


def format_conversations(conversations: DataFrame, most: int = MOST_IN_SEQUENCE) -> tuple[DataFrame, DataFrame]:
    """(sequences, members): SEQUENCE_SCHEMA, and (conv_id, path) of every conversation.

    Turns go by turn, then role, then text; repeated turn numbers are all kept.  A null role or text counts as empty, and
    a row of a null conv_id is a conversation of its own.  Equal conversations are one leaf with several members.  A tree
    of up to ``most`` different conversations is one sequence; in a larger one, turns that more of them share are
    trunks.  Every beginning of a conversation is one node in all sequences.  Other columns are not looked at; an empty
    table gives empty results.
    """
    spark = conversations.sparkSession
    members = common.materialize(turns_of(conversations), "conversations")
    # Of equal conversations one is kept, the others only named.
    paths = members.select("conv_id", "path", "d").groupBy("path").agg(F.first("d").alias("d"), F.count("*").alias("n"), F.min("conv_id").alias("least"))
    paths = common.materialize(paths, "paths")
    again = common.materialize(paths.filter("n > 1").select("path", "least"), "repeated")
    n_again = again.count()
    dealt, of_trunk = trunks(paths.select("path", "d"), most)
    dealt, of_trunk = common.materialize(dealt, "dealt"), common.materialize(of_trunk, "trunks")
    n_dealt, n_trunks = dealt.count(), of_trunk.count()

    single = members.join(common.broadcast_if_small(again.select("path"), n_again, MOST_TRUNKS_BROADCAST), "path", "left_anti")
    several = members.join(common.broadcast_if_small(again, n_again, MOST_TRUNKS_BROADCAST), "path").filter(F.col("conv_id").eqNullSafe(F.col("least"))).dropDuplicates(["path"])
    one = single.select("path", "d", "roles", "texts").unionByName(several.select("path", "d", "roles", "texts"))
    placed = one.join(common.broadcast_if_small(dealt, n_dealt, MOST_TRUNKS_BROADCAST), "path", "left").filter("sequence IS NOT NULL OR ancestor IS NULL")
    plain = placed.select(F.coalesce("sequence", F.col("d")[0]).alias("sequence"), "ancestor", F.lit(False).alias("trunk"), F.coalesce("cut", F.lit(0)).alias("cut"), "path", "roles", "texts")
    shown = one.join(common.broadcast_if_small(of_trunk, n_trunks, MOST_TRUNKS_BROADCAST), "path")
    upto = lambda c: F.slice(c, F.lit(1), F.col("stop")).alias(c)
    above = shown.select("sequence", "ancestor", F.lit(True).alias("trunk"), "cut", F.col("leaf").alias("path"), upto("roles"), upto("texts"))
    n_parts = common.shuffle_partitions(spark)
    sequences = plain.unionByName(above).repartition(n_parts, "sequence").sortWithinPartitions("sequence").mapInArrow(_build, SEQUENCE_SCHEMA)
    return common.materialize(sequences, "sequences"), members.select("conv_id", "path")


def trunk_texts(sequences: DataFrame) -> tuple[DataFrame, int, int]:
    """(sequence, before, loss) of every trunk: the text of all its ancestors and itself, and the spans of the loss in it; trunks, characters.

    Each round joins chains of double length.
    """
    loss = F.transform(F.filter("nodes", lambda n: n["loss_start"] >= 0), lambda n: F.struct(n["loss_start"].alias("start"), n["loss_end"].alias("end")))
    rows = common.materialize(sequences.filter("trunk").select("sequence", "ancestor", F.col("text").alias("before"), loss.alias("loss")), "trunk-texts")
    while rows.filter("ancestor IS NOT NULL").limit(1).count():
        above = rows.select(F.col("sequence").alias("ancestor"), F.col("ancestor").alias("up"), F.col("before").alias("b"), F.col("loss").alias("l"))
        moved = F.transform("loss", lambda x: F.struct((x["start"] + F.length("b")).alias("start"), (x["end"] + F.length("b")).alias("end")))
        longer = rows.filter("ancestor IS NOT NULL").join(above, "ancestor").select("sequence", F.col("up").alias("ancestor"), F.concat("b", "before").alias("before"), F.concat("l", moved).alias("loss"))
        rows = common.materialize(rows.filter("ancestor IS NULL").unionByName(longer), "trunk-texts")
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("before")), F.lit(0))).first()
    return rows.drop("ancestor"), n, chars


READ_SCHEMA = "path string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(sequences: DataFrame) -> DataFrame:
    """READ_SCHEMA for each leaf, from the sequences' texts, attention intervals, loss spans and ancestors alone."""
    chains, n, chars = trunk_texts(sequences)
    small = n if chars <= MOST_TRUNK_CHARS else MOST_TRUNKS_BROADCAST + 1
    chains = chains.select(F.col("sequence").alias("ancestor"), "before", "loss")
    rows = sequences.filter(F.size("leaves") > 0).select("ancestor", "position", "text", "nodes", "leaves")
    first = rows.filter("ancestor IS NULL").select("position", "text", "nodes", "leaves", F.lit("").alias("before"), F.array().cast("array<struct<start:long,end:long>>").alias("loss"))
    later = rows.join(common.broadcast_if_small(chains, small, MOST_TRUNKS_BROADCAST), "ancestor").select("position", "text", "nodes", "leaves", "before", "loss")

    def sha(s: str) -> str:
        return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def one(text, nodes, leaf, before, loss):
        chain, k = [], leaf["node"]
        while k >= 0:
            chain.append(nodes[k])
            k = nodes[k]["parent"]
        chain.reverse()
        whole = before
        if chain:
            last = chain[-1]
            whole += "".join(text[s["start"] : s["end"]] for s in last["attends"]) + text[last["start"] : last["end"]]
            if len(whole) != last["position"] + last["end"] - last["start"]:
                raise ValueError("positions do not fit the attention intervals")
        said = "".join(f"{role}\n{t}\n" for role, t in (parse_turn(x + END) for x in whole.split(END)[:-1]))
        learned = "".join([*(unescape(before[s["start"] : s["end"]]) for s in loss), *(unescape(text[n["loss_start"] : n["loss_end"]]) for n in chain if n["loss_start"] >= 0)])
        return leaf["path"], whole.count(END), sha(said), len(learned), sha(learned), len(whole)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ("path", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in ("position", "text", "nodes", "leaves", "before", "loss")}
                if row["position"] != len(row["before"]):
                    raise ValueError("positions do not fit the ancestors")
                found = [one(row["text"], row["nodes"], leaf, row["before"], row["loss"]) for leaf in row["leaves"]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=list(names))

    return first.unionByName(later).mapInArrow(read, READ_SCHEMA)


QUERY = "op2_format_conversations"
#: The contract's extra conversation, of control strings only.
EXTRA_ID, EXTRA_TEXT = -7, "</s>[INST] ok [/INST]"


def with_extra(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    extra = conversations.sparkSession.createDataFrame([(EXTRA_ID, 0, "user", EXTRA_TEXT), (EXTRA_ID, 1, "assistant", EXTRA_TEXT)], rows.schema)
    return rows.unionByName(extra)


def query(spark, sf_dir: str) -> DataFrame:
    sequences, members = format_conversations(with_extra(common.table(spark, sf_dir, "conversations")))
    return members.join(read_back(sequences), "path").drop("path")


def _escaped_sql(value: str, role: bool) -> str:
    out = f"replace({value}, '\\', '\\\\')"
    for c, code in _CODES.items():
        if c != "\\" and (role or c != "\n"):
            out = f"replace({out}, {'chr(10)' if c == chr(10) else repr(c)}, '\\{code}')"
    return out


SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {EXTRA_ID}, t, r, '{EXTRA_TEXT}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = '{LEARNED_ROLE}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{LEARNED_ROLE}'), '')) AS loss_sha256,
  CAST(sum({len(START) + 1 + len(END)} + length({_escaped_sql("role", True)}) + length({_escaped_sql("text", False)})) AS BIGINT) AS formatted_chars
FROM (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own FROM c) GROUP BY conv_id, own"""
