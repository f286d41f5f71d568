r"""Repair of conversation structure, by a dynamic program whose layers conversations share.

1. Rows are put in order (conversation, turn with nulls first, role, text) by a range exchange, so that a long
   conversation is spread over tasks, and written with their place.
2. A row's symbol is its role's initial (s, u, a or another) and its first fault: blank, duplicate, truncated or none. A
   conversation's signature is its rows' symbols in order; pieces of up to 4,096 rows are made first.
3. Distinct signatures, sorted, form a prefix trie that is walked in order: a layer holds the least cost of reaching each
   state of `(s?(ua)+)?` after a prefix, and layers of a prefix that two signatures share are computed once. At a
   signature's end the layers give its cost, and the ASCII-least of its cheapest edits: states that lie on a cheapest way
   are marked from the end, then followed from the start. Ranges of the sorted signatures are independent.
4. The answers go back to conversations by signature; a common signature's conversations stay where they are.
5. Each conversation's edits and then its rows stream through one task in order, which digests the repaired text. SHA-256
   of one text can't be split; the task holds the edits (a byte each) and one row at a time, however long the conversation.

Edits are Delete (cost 3; blank and duplicate rows must go), Insert (2), Keep (0) and Rerole (2), written D, I, K, R; a
truncated row that stays costs 1 more.

Defined cases: a null conv_id is a conversation of its own; null turns come first and count for no gap; a null role or
text is one space; rows of equal turn are in order of role, then text; repeated rows are duplicates; a conversation
without rows has zeros, no edits and the digest of the empty string; an empty table gives no rows; other columns, whatever their
names, are ignored. Texts stay whole.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import with_key_row, written

INITIALS = "sua"
FAULTS = ("none", "blank", "duplicate", "truncated")
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
#: From a state, the next of u and a goes to this state.
NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
PIECE_BITS = 12
FAR = 1 << 40
NO_WORD = r"[^\x20\x09-\x0D]"
_ENDS_OPEN = r"(?s)[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z"


def damaged(rows: DataFrame) -> DataFrame:
    """c (the conversation's key), turn, role, text of the rows that a checksum of `conv_id:turn` leaves, damages or repeats."""
    conv, turn = (F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("conv_id", "turn"))
    hit = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    text = F.when(hit == 1, "").when(hit == 2, F.translate(text, ".!?", "")).otherwise(text)
    copies = F.explode(F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where(hit != 0).select(key_of("conv_id").alias("c"), "turn", F.when(hit == 4, "user").otherwise(role).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def key_of(column: str):
    """A conversation's key, also of a null id."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(" "))


def ordered(turns: DataFrame) -> DataFrame:
    """turns with pos, which rises along each conversation; a written table."""
    head = F.substring("text", 1, 64)  # bounds of ranges go through the driver
    ranged = turns.repartitionByRange("c", F.asc_nulls_first("turn"), "role", head).sortWithinPartitions("c", F.asc_nulls_first("turn"), "role", "text")
    return written(ranged.withColumn("pos", F.monotonically_increasing_id()), "turns")


def signatures(turns: DataFrame) -> DataFrame:
    """c, signature: a hexadecimal digit for each row, 4 * place of the initial in `sua?` + place of the fault in FAULTS."""
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(~F.col("text").rlike(NO_WORD), 1).when(F.col("text").rlike(_ENDS_OPEN), 3).otherwise(0)
    who = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    small = written(turns.select("c", "pos", role.alias("role"), fault.alias("fault"), who.alias("who")), "turn-symbols")
    again = small.where("fault <> 1").groupBy("c", "who").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    told = with_key_row(small, written(again, "turns-again"), ["c", "who"], "n", small.count(), "left", few=100_000)
    fault = F.when((F.col("fault") != 1) & (F.col("pos") > F.col("first")), 2).otherwise(F.col("fault"))
    digit = F.lower(F.hex((F.col("role") * 4 + fault).cast("long")))
    pieces = told.groupBy("c", F.shiftright("pos", PIECE_BITS).alias("piece")).agg(F.sort_array(F.collect_list(F.struct("pos", digit.alias("s")))).alias("rows"))
    pieces = pieces.select("c", F.struct("piece", F.array_join("rows.s", "").alias("s")).alias("p"))
    return pieces.groupBy("c").agg(F.array_join(F.sort_array(F.collect_list("p"))["s"], "").alias("signature"))


def _edits(symbol: int) -> list[tuple[str, int, int, int]]:
    """(edit, from state, to state, cost) of a row."""
    role, fault = divmod(symbol, 4)
    out = [("D", s, s, DELETE) for s in range(4)]
    if FAULTS[fault] in ("blank", "duplicate"):
        return out
    more = TRUNCATED if FAULTS[fault] == "truncated" else 0
    if role == INITIALS.index("s"):
        out.append(("K", START, SYSTEM, more))
    for s, t in NEXT.items():
        if role == INITIALS.index("a" if t == ASSISTANT else "u"):
            out.append(("K", s, t, more))
        out.append(("R", s, t, REROLE + more))
    return out


EDITS = [_edits(x) for x in range(16)]


def _with_inserts(f: list[int]) -> list[int]:
    f[USER] = min(f[USER], min(f[START], f[SYSTEM], f[ASSISTANT]) + INSERT)
    f[ASSISTANT] = min(f[ASSISTANT], f[USER] + INSERT)
    return f


class Trie:
    """The path from a prefix trie's root to the signature that was asked for last, with a layer of costs at each node."""

    def __init__(self):
        self.path, self.layers = "", array("q", _with_inserts([0, FAR, FAR, FAR]))

    def __call__(self, signature: str) -> tuple[int, str]:
        """Cost and edits."""
        shared, most = 0, min(len(self.path), len(signature))
        while shared < most and self.path[shared] == signature[shared]:
            shared += 1
        layers, self.path = self.layers, signature
        del layers[4 * (shared + 1) :]
        f = list(layers[-4:])
        for digit in signature[shared:]:
            g = [FAR] * 4
            for _, s, t, cost in EDITS[int(digit, 16)]:
                if f[s] + cost < g[t]:
                    g[t] = f[s] + cost
            f = _with_inserts(g)
            layers.extend(f)
        return min(f[START], f[ASSISTANT]), self._audit(signature)

    def _audit(self, signature: str) -> str:
        f, n = self.layers, len(signature)
        total = min(f[4 * n + START], f[4 * n + ASSISTANT])
        on_way = bytearray(n + 1)  # a bit for each state that lies on a cheapest way
        on_way[n] = sum(1 << s for s in (START, ASSISTANT) if f[4 * n + s] == total)
        for k in range(n, -1, -1):
            for t, befores in ((ASSISTANT, (USER,)), (USER, (START, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
                if on_way[k] >> t & 1:
                    for s in befores:
                        if f[4 * k + s] + INSERT == f[4 * k + t]:
                            on_way[k] |= 1 << s
            if k:
                for _, s, t, cost in EDITS[int(signature[k - 1], 16)]:
                    if on_way[k] >> t & 1 and f[4 * k - 4 + s] + cost == f[4 * k + t]:
                        on_way[k - 1] |= 1 << s
        out, k, s = [], 0, START
        while k < n or s not in (START, ASSISTANT) or f[4 * k + s] != total:
            best = ("Z", k, s)
            if f[4 * k + s] + INSERT == f[4 * k + NEXT[s]] and on_way[k] >> NEXT[s] & 1:
                best = ("I", k, NEXT[s])
            if k < n:
                for edit, a, t, cost in EDITS[int(signature[k], 16)]:
                    if a == s and edit < best[0] and on_way[k + 1] >> t & 1 and f[4 * k + s] + cost == f[4 * k + 4 + t]:
                        best = (edit, k + 1, t)
            edit, k, s = best
            out.append(edit)
        return "".join(out)


_ROLE_OF = str.maketrans("0123456789abcdef", "ssssuuuuaaaa----")


def told(signature: str) -> tuple[int, int, int, int]:
    """blank, duplicate, truncated, illegal of a signature."""
    faults = [sum(signature.count("%x" % (4 * role + k)) for role in range(4)) for k in (1, 2, 3)]
    roles = signature.translate(_ROLE_OF)
    return *faults, max(0, len(roles) - 1) - sum(roles.count(pair) for pair in ("su", "ua", "au"))


def answers(forms: DataFrame) -> DataFrame:
    """signature, size, blank, duplicate, truncated, illegal, cost, audit of distinct signatures (signature, size)."""
    names = ["blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches):
        trie = Trie()
        for batch in batches:
            rows = []
            for s in batch.column(0).to_pylist():
                cost, audit = trie(s)
                rows.append((*told(s), cost, audit))
            columns = [pa.array([r[k] for r in rows], pa.int64() if k < 5 else pa.string()) for k in range(6)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["signature", "size", *names, "audit"])

    ranged = forms.select("signature", "size").repartitionByRange("signature").sortWithinPartitions("signature")
    return ranged.mapInArrow(run, "signature string, size long, " + ", ".join(f"{x} long" for x in names) + ", audit string")


class Repaired:
    """The digest of one conversation's repaired text, row after row."""

    def __init__(self, key, audit: str):
        self.key, self.audit, self.at, self.sha, self.state, self.empty = key, audit, 0, hashlib.sha256(), START, True

    def _put(self, role: str, text: str) -> None:
        self.sha.update((f"{role}:{text}" if self.empty else f"\n{role}:{text}").encode("utf-8", "surrogatepass"))
        self.empty = False

    def _next(self, role: str | None, text: str) -> None:
        system = role is not None and self.state == START and role[:1] == "s"
        self.state = SYSTEM if system else NEXT[self.state]
        self._put(role if role is not None else "user" if self.state == USER else "assistant", text)

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._next(None, "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._next(role if edit == "K" else None, text)


def digests(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """c, repaired_sha256: edits of a conversation (c, audit) stand before its rows (c, pos, role, text)."""

    def run(batches):
        now = None
        for batch in batches:
            done = []
            for c, pos, role, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if pos < 0:
                    if now:
                        now.inserts()
                        done.append(now)
                    now = Repaired(c, text)
                else:
                    now.row(role, text)
            yield _told(done)
        if now:
            now.inserts()
            yield _told([now])

    def _told(done):
        return pa.RecordBatch.from_arrays([pa.array([x.key for x in done], pa.string()), pa.array([x.sha.hexdigest() for x in done], pa.string())], ["c", "repaired_sha256"])

    edits = audits.select("c", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text"))
    rows = edits.unionByName(turns.select("c", "pos", "role", "text")).repartition("c").sortWithinPartitions("c", "pos")
    return rows.mapInArrow(run, "c string, repaired_sha256 string")


def repaired(conversations: DataFrame) -> DataFrame:
    """A row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    turns = ordered(damaged(rows))
    shapes = written(signatures(turns), "signatures")
    forms = written(answers(shapes.groupBy("signature").agg(F.count("*").alias("size"))), "signature-answers")
    judged = written(with_key_row(shapes, forms, "signature", "size", shapes.count()).drop("signature", "size"), "conversation-answers")
    gap = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    gaps = turns.groupBy("c").agg(gap.alias("gaps"))
    all_of = judged.join(gaps, "c").join(digests(turns, judged), "c")
    ids = rows.select("conv_id", key_of("conv_id").alias("c")).distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    nothing = hashlib.sha256(b"").hexdigest()
    return ids.join(all_of, "c", "left").select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256")
    )
