"""Repair of the structure of conversations by dynamic programming over a grammar.

A turn is one symbol: the initial of its role (system, user, assistant, other) and its fault, if any. A conversation is a string of
symbols; equal strings are one. Frequent neighbours become rules, rounds of Re-Pair at a time, until no pair occurs twice or
``rounds`` is reached; what is left stays a short string of rules. The automaton of roles ``(s?(ua)+)?`` has four states. Each symbol has one
min-plus matrix over them: the cheapest edits of one turn, with the insertions before it, that lead from a state to another, with
the audit of these edits as a rope. The matrix of a rule is the product of its two parts, evaluated bottom-up, once for all
conversations, so that ropes share their parts. A conversation is the product of its few remaining symbols.

Equal costs go to the audit that is least in ASCII. Two audits of equal cost over the same turns are never one the beginning of the other
(the rest would be insertions, which cost), so a least audit is put together from least parts.

Rows are dealt by ranges of (conversation, turn, role, beginning of the text), so a conversation with many rows is spread over tasks. A task
reads its rows in order and closes a piece after ``piece_rows`` rows or ``piece_bytes`` of text; a conversation that may go on in another task or
piece is put together from its pieces' products. Faults, gaps and neighbours are counted by piece and joined in the same way.

Defined results: null roles and texts are taken as empty; rows of one turn are ordered by role and text, null turns come first; a null id is a
conversation like any other; a repeated row is a turn each time. Conversations without rows are not in the tables (an empty table gives no
rows). Very long texts are read whole. The audit of a conversation is one value, so that one task holds it, and its symbols, one byte a turn.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from obsframe.session import scratch_path

SPACE = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}


@dataclass(frozen=True)
class Settings:
    insert: int = 3
    rerole: int = 3
    delete: int = 4
    truncated: int = 3
    rounds: int = 12
    rules: int = 512  # at most, a round
    piece_rows: int = 4096
    piece_bytes: int = 1 << 20


# ---- ropes: strings, put together without copying the parts of long ones ----

class Rope:
    __slots__ = ("left", "right", "size")

    def __init__(self, left, right):
        self.left, self.right, self.size = left, right, len(left) + len(right)

    def __len__(self) -> int:
        return self.size


def joined(left, right):
    if not left or not right:
        return left or right
    if type(left) is type(right) is str and len(left) + len(right) <= 256:
        return left + right
    return Rope(left, right)


def leaves(rope) -> Iterator[str]:
    todo = [rope]
    while todo:
        part = todo.pop()
        if type(part) is str:
            yield part
        else:
            todo += [part.right, part.left]


def less(a, b) -> bool:
    """Whether ``a`` comes before ``b``; equal parts of one rope are passed over at once."""
    left, right = [a], [b]
    while left and right:
        x, y = left.pop(), right.pop()
        if x is y:
            continue
        if type(x) is not str and (type(y) is str or len(x) >= len(y)):
            left += [x.right, x.left]
            right.append(y)
        elif type(y) is not str:
            right += [y.right, y.left]
            left.append(x)
        else:
            n = min(len(x), len(y))
            if x[:n] != y[:n]:
                return x[:n] < y[:n]
            left += [x[n:]] * (len(x) > n)
            right += [y[n:]] * (len(y) > n)
    return bool(right) and not left


# ---- matrices over the states: 0 nothing yet, 1 system, 2 user, 3 assistant ----

Entry = tuple[int, object]  # cost, audit


def better(new: Entry | None, old: Entry | None) -> bool:
    return new is not None and (old is None or new[0] < old[0] or (new[0] == old[0] and less(new[1], old[1])))


def after(first: Entry | None, second: Entry | None) -> Entry | None:
    return None if first is None or second is None else (first[0] + second[0], joined(first[1], second[1]))


def step(row: list, matrix: list) -> tuple[list, list]:
    """The cheapest ways to each state after one more matrix, and the states they come through."""
    out, through = [None] * 4, [0] * 4
    for m in range(4):
        if row[m] is not None:
            for j in range(4):
                new = after(row[m], matrix[m][j])
                if better(new, out[j]):
                    out[j], through[j] = new, m
    return out, through


def product(a: list, b: list) -> list:
    return [step(row, b)[0] for row in a]


def insertions(cfg: Settings) -> list:
    one, two = (cfg.insert, "I"), (2 * cfg.insert, "II")
    none = (0, "")
    return [[none, None, one, two], [None, none, one, two], [None, None, none, one], [None, None, one, none]]


def symbol_matrix(symbol: str, cfg: Settings) -> list:
    """One turn: ``x`` has to go, capital letters are truncated."""
    edits = [[None] * 4 for _ in range(4)]
    for i in range(4):
        edits[i][i] = (cfg.delete, "D")
    if symbol != "x":
        more, role = cfg.truncated * symbol.isupper(), symbol.lower()
        moves = [(0, 1, "s"), (0, 2, "u"), (1, 2, "u"), (3, 2, "u"), (2, 3, "a")]
        for i, j, initial in moves:
            keep, rerole = (more, "K") if role == initial else None, (cfg.rerole + more, "R") if initial != "s" else None
            edits[i][j] = keep if better(keep, rerole) else rerole
    return product(insertions(cfg), edits)


SYMBOLS = "xsuaoSUAO"


@dataclass
class Grammar:
    """Rules over pairs of symbols (numbers; the single turns come first) and the matrix of each."""

    cfg: Settings
    rules: dict[tuple[int, int], int] = field(default_factory=dict)
    matrices: list = field(default_factory=list)

    def __post_init__(self):
        self.matrices = [symbol_matrix(s, self.cfg) for s in SYMBOLS]

    def add(self, pairs: Iterable[tuple[int, int]]) -> None:
        for a, b in pairs:
            self.rules[a, b] = len(self.matrices)
            self.matrices.append(product(self.matrices[a], self.matrices[b]))

    def encode(self, symbols: str) -> list[int]:
        """The symbols with every rule applied, earlier rules first."""
        code = [SYMBOLS.index(s) for s in symbols]
        while len(code) > 1:
            rule, a, b = min(((self.rules[p], *p) for p in zip(code, code[1:]) if p in self.rules), default=(None, 0, 0))
            if rule is None:
                break
            out, i = [], 0
            while i < len(code):
                if i + 1 < len(code) and code[i] == a and code[i + 1] == b:
                    out.append(rule)
                    i += 2
                else:
                    out.append(code[i])
                    i += 1
            code = out
        return code

    def matrix(self, symbols: str) -> list:
        """The matrix of a whole string; shared by all that bear the same string."""
        found = None
        for number in self.encode(symbols):
            found = self.matrices[number] if found is None else product(found, self.matrices[number])
        return found


def cheapest(matrices: list, cfg: Settings) -> tuple[int, list[tuple[int, str]]]:
    """Least cost over pieces in order, and for each piece the state it starts in and its edits (the last with closing insertions)."""
    row, ways = [(0, ""), None, None, None], []
    for matrix in matrices:
        row, through = step(row, matrix)
        ways.append(through)
    ends, through = step(row, insertions(cfg))
    end = 3 if better(ends[3], ends[0]) else 0
    at, closing = through[end], insertions(cfg)[through[end]][end][1]
    edits = []
    for matrix, way in zip(reversed(matrices), reversed(ways)):
        edits.append((way[at], "".join(leaves(matrix[way[at]][at][1])) + closing))
        at, closing = way[at], ""
    return ends[end][0], edits[::-1]


def rebuilt(roles: list[str], texts: list[str], edits: str, state: int) -> list[tuple[str, str, str]]:
    """Role, text and edit of the turns that the edits leave or insert, from a state of the automaton on."""
    out, rows = [], iter(zip(roles, texts))
    for edit in edits:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if state == 2 else "user"
        state = {"s": 1, "u": 2, "a": 3}[role[0]]
        out.append((role, text, edit))
    return out


# ---- tables ----

_TURNS = "array<struct<role:string,text:string,edit:string>>"
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def _batched(rows: Iterable[dict], schema: pa.Schema, size: Callable[[dict], int] = lambda row: 1, limit: int = 1000) -> Iterator[pa.RecordBatch]:
    """Rows in batches of a bounded size."""
    some, total = [], 0
    for row in rows:
        some.append({n: row[n] for n in schema.names})
        total += size(row)
        if total >= limit:
            yield pa.RecordBatch.from_pylist(some, schema=schema)
            some, total = [], 0
    if some:
        yield pa.RecordBatch.from_pylist(some, schema=schema)


def _each(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(0, batch.num_rows, 100):
            yield from batch.slice(i, 100).to_pylist()


def _pieces(cfg: Settings, schema: T.StructType):
    """Sorted rows become pieces: the symbols, counts and both ends of a run of one conversation's turns, with the turns."""
    arrow = to_arrow_schema(schema)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(runs(batches), arrow, lambda row: row["bytes"] + 100 * len(row["roles"]), cfg.piece_bytes)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, number, piece, last, opened = TaskContext.get().partitionId(), 0, None, None, False

        def closed(p: dict, ends: bool) -> dict:
            nonlocal number, opened
            # The first and the last conversation of a task may have turns elsewhere, and one cut here goes on.
            whole = ends and not opened and number > 0
            opened = not ends
            number += 1
            return p | {"part": part, "seq": number, "whole": whole, "symbols": "".join(p["symbols"])}

        for row in _each(batches):
            conv, turn, role, text = row["conv"], row["turn"], row["role"], row["text"]
            same = last is not None and last[0] == conv
            if piece and not same:
                yield closed(piece, True)
                piece = None
            elif piece and (len(piece["roles"]) >= cfg.piece_rows or piece["bytes"] >= cfg.piece_bytes):
                yield closed(piece, False)
                piece = None
            initial, core = role[:1], text.strip(SPACE)
            fault = "blank" if not core else "duplicate" if row["again"] or last == (conv, turn, role, text) else "truncated" if core[-1] not in ".!?" else ""
            symbol = initial if initial and initial in "sua" else "o"
            symbol = "x" if fault in ("blank", "duplicate") else symbol.upper() if fault else symbol
            if piece is None:
                piece = {"conv": conv, "symbols": [], "roles": [], "texts": [], "bytes": 0, "blank": 0, "duplicate": 0, "truncated": 0}
                piece |= {"illegal": 0, "turns": 0, "lo": turn, "hi": turn, "first": initial, "last": initial, "known": False}
            else:
                piece["illegal"] += last[2][:1] + initial not in LEGAL
                piece["last"] = initial
            if turn is not None:
                piece["turns"] += not piece["known"] or turn != piece["hi"]
                piece["lo"] = turn if not piece["known"] else piece["lo"]
                piece["hi"], piece["known"] = turn, True
            if fault:
                piece[fault] += 1
            piece["symbols"].append(symbol)
            piece["roles"].append(role)
            piece["texts"].append(text)
            piece["bytes"] += len(text)
            last = (conv, turn, role, text)
        if piece:
            opened = True
            yield closed(piece, True)

    return split


def _grammar(pieces: DataFrame, cfg: Settings) -> Grammar:
    """Rounds of Re-Pair over the distinct strings; each round counts all pairs in Spark and takes the most frequent ones."""
    spark = pieces.sparkSession
    path = scratch_path(spark, "strings")
    pieces.groupBy("symbols").agg(F.count(F.lit(1)).alias("times")).where("length(symbols) > 1").write.parquet(path)
    strings, grammar = spark.read.parquet(path), Grammar(cfg)
    for _ in range(cfg.rounds):
        shared = spark.sparkContext.broadcast(grammar.rules)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, found = Grammar(cfg), Counter()
            known.rules = shared.value
            for batch in batches:
                for symbols, times in zip(batch.column("symbols").to_pylist(), batch.column("times").to_pylist()):
                    code = known.encode(symbols)
                    for pair in zip(code, code[1:]):
                        found[pair] += times
            if found:
                columns = [pa.array(x, pa.int64()) for x in zip(*((a, b, n) for (a, b), n in found.items()))]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "n"])

        pairs = strings.mapInArrow(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
        most = pairs.where("n > 1").orderBy(F.desc("n"), "a", "b").limit(cfg.rules).collect()
        shared.unpersist()
        if not most:
            break
        grammar.add((r["a"], r["b"]) for r in most)
    return grammar


def repair_conversations(
    rows: DataFrame, cfg: Settings = Settings(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """A report and the repaired turns of every conversation that has rows.

    The report has ``conv``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost`` and ``audit``. The turns come in
    pieces: ``conv``, ``place`` (ascending), ``whole`` (the only piece of its conversation, for certain) and ``turns`` (role, text, edit).
    """
    spark = rows.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    plain = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("said", F.md5(F.to_json(F.struct("role", "text"))))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    repeated = plain.groupBy("conv", "said").agg(F.min(order).alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = kept(repeated.select(F.col("conv").alias("conv_"), F.col("said").alias("said_"), "earliest"), "repeated")
    marked = plain.join(repeated, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("said") == F.col("said_")), "left")
    marked = marked.select("conv", "turn", "role", "text", F.coalesce(order > F.col("earliest"), F.lit(False)).alias("again"))
    keys = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("role")]
    dealt = marked.repartitionByRange(*keys, F.asc(F.substring("text", 1, 64))).sortWithinPartitions(*keys, F.asc("text"))

    id_type = rows.schema[conv_col].dataType
    ddl = "part int, seq int, whole boolean, symbols string, blank long, duplicate long, truncated long, illegal long, turns long, lo long, hi long, first string, last string, roles array<string>, texts array<string>"
    schema = T.StructType([T.StructField("conv", id_type), *T.StructType.fromDDL(ddl).fields])
    pieces = kept(dealt.mapInArrow(_pieces(cfg, schema), schema), "pieces")
    grammar = spark.sparkContext.broadcast(_grammar(pieces, cfg))

    counts = ", ".join(f"{c} long" for c in _COUNTS)
    done = T.StructType([T.StructField("conv", id_type), *T.StructType.fromDDL(f"part int, seq int, whole boolean, {counts}, cost long, audit string, edits string, state int").fields])

    def repair(strings: dict, symbols: str) -> tuple[int, int, str]:
        found = strings.get(symbols)
        if found is None:
            if len(strings) >= 100_000:
                strings.clear()
            cost, [(state, edits)] = cheapest([grammar.value.matrix(symbols)], cfg)
            found = strings[symbols] = cost, state, edits
        return found

    arrow_done = to_arrow_schema(done)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings: dict[str, tuple[int, int, str]] = {}

        def repaired() -> Iterator[dict]:
            for row in _each(batches):
                cost, state, edits = repair(strings, row["symbols"])
                gaps = row["hi"] - row["lo"] + 1 - row["turns"] if row["turns"] else 0
                yield row | {"gaps": gaps, "cost": cost, "audit": edits, "edits": edits, "state": state}

        return _batched(repaired(), arrow_done)

    def together(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["seq"]))
        matrices: dict[str, list] = {}
        for row in rows:
            if row["symbols"] not in matrices:
                matrices[row["symbols"]] = grammar.value.matrix(row["symbols"])
        cost, edits = cheapest([matrices[r["symbols"]] for r in rows], cfg)
        known = [r for r in rows if r["turns"]]
        turns = sum(r["turns"] for r in known) - sum(a["hi"] == b["lo"] for a, b in zip(known, known[1:]))
        total = {c: sum(r[c] for r in rows) for c in _COUNTS[1:]}
        total["gaps"] = known[-1]["hi"] - known[0]["lo"] + 1 - turns if known else 0
        total["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(rows, rows[1:]))
        audits = ["".join(e for _, e in edits)] + [None] * (len(rows) - 1)  # the report reads the first piece
        out = [r | total | {"cost": cost, "audit": a, "edits": e, "state": s} for r, a, (s, e) in zip(rows, audits, edits)]
        return pa.Table.from_batches(_batched(out, arrow_done), arrow_done)

    slim = pieces.drop("roles", "texts")
    single = slim.where("whole").mapInArrow(alone, done)
    several = slim.where("not whole").groupBy("conv").applyInArrow(together, done)
    found = kept(single.unionAll(several), "repairs")
    report = found.where("audit is not null").select("conv", *_COUNTS, "cost", "audit")

    turn_schema = T.StructType([T.StructField("conv", id_type), *T.StructType.fromDDL(f"place long, whole boolean, turns {_TURNS}").fields])

    arrow_turns = to_arrow_schema(turn_schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[dict]:
            for row in _each(batches):
                turns = [dict(zip(("role", "text", "edit"), t)) for t in rebuilt(row["roles"], row["texts"], row["edits"], row["state"])]
                yield {"conv": row["conv"], "place": (row["part"] << 32) + row["seq"], "whole": row["whole"], "turns": turns}

        return _batched(made(), arrow_turns, lambda row: 100 + sum(100 + len(t["text"]) for t in row["turns"]), cfg.piece_bytes)

    edits = found.select("part", "seq", "edits", "state")
    return report, pieces.join(edits, ["part", "seq"]).mapInArrow(apply, turn_schema)


def digests(turns: DataFrame) -> DataFrame:
    """``conv`` and ``sha256`` of its repaired turns, written ``role:text`` and joined by newlines.

    A conversation of one piece is hashed as it comes; the pieces of the others are read in order, and only the state of the hash is held.
    """
    path = scratch_path(turns.sparkSession, "turns")
    turns.write.parquet(path)
    turns = turns.sparkSession.read.parquet(path)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    pieces = turns.select("conv", "place", "whole", lines.alias("lines"), (F.size("turns") > 0).alias("any"))
    schema = T.StructType([turns.schema["conv"], T.StructField("sha256", T.StringType())])
    arrow = to_arrow_schema(schema)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashed() -> Iterator[dict]:
            now, digest, begun = None, None, False
            for row in _each(batches):
                if digest is None or row["conv"] != now:
                    if digest is not None:
                        yield {"conv": now, "sha256": digest.hexdigest()}
                    now, digest, begun = row["conv"], hashlib.sha256(), False
                if row["any"]:
                    digest.update(("\n" if begun else "").encode() + row["lines"].encode())
                    begun = True
            if digest is not None:
                yield {"conv": now, "sha256": digest.hexdigest()}

        return _batched(hashed(), arrow)

    rest = pieces.where("not whole").repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), "place")
    rest = rest.select("conv", "lines", "any").mapInArrow(stream, schema)
    return pieces.where("whole").select("conv", F.sha2("lines", 256).alias("sha256")).unionAll(rest)
