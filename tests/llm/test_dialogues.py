import hashlib
import random
import re
import zlib
from functools import lru_cache

from annalist.llm.dialogues import Trie, repaired, told

ENDS = re.compile(r"[^\x20\x09-\x0D]")


def plain(rows):
    """conv_id -> the result's columns, by loops over rows (conv_id, turn, role, text)."""
    out = {}
    for conv, *_ in rows:
        out.setdefault(conv, [])
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit == 1:
            text = ""
        if hit == 2:
            text = re.sub("[.!?]", "", text)
        if hit == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return {conv: one(sorted(kept, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2].encode()))) for conv, kept in out.items()}


def one(rows):
    turns = {t for t, *_ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    faults, seen = [], set()
    for _, role, text in rows:
        words = ENDS.findall(text)
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    if len(rows) < 100:
        cost, audit = cheapest(tuple((r[1][:1], f) for r, f in zip(rows, faults, strict=True)))
    else:  # the trie itself is held against all ways above
        places = ["", "blank", "duplicate", "truncated"]
        cost, audit = Trie()("".join("%x" % (4 * max("sua".find(r[1][0]), 0) + places.index(f)) for r, f in zip(rows, faults, strict=True)))
    said, k, want = [], 0, "user"
    for edit in audit:
        role, text = (None, "") if edit == "I" else rows[k][1:]
        k += edit != "I"
        if edit == "D":
            continue
        said.append(f"{role if edit == 'K' else want}:{text}")
        want = "user" if edit == "K" and role[:1] == "s" else "assistant" if want == "user" else "user"
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


def cheapest(rows):
    """(cost, edits): every choice at every row, from the end, by the roles that were given so far."""

    @lru_cache(None)
    def rest(k, roles, inserted):
        ways = []
        if re.fullmatch("(s?(ua)+)?", roles) and k == len(rows):
            ways.append((0, ""))
        nxt = "a" if roles.endswith("u") else "u"

        def then(edit, cost, k, roles, inserted=0):
            tail = roles[-2:] if roles[-2:] in ("ua", "su") or len(roles) < 2 else "s" + roles[-1] if roles[-1] == "u" else roles
            more, edits = rest(k, {"ua": "ua", "au": "u"}.get(roles[-2:], tail), inserted)
            ways.append((cost + more, edit + edits))

        if inserted < 3:
            then("I", 2, k, roles + nxt, inserted + 1)
        if k < len(rows):
            role, fault = rows[k]
            then("D", 3, k + 1, roles)
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role == nxt or role == "s" and not roles:
                    then("K", more, k + 1, roles + role)
                then("R", 2 + more, k + 1, roles + nxt)
        return min(ways, default=(10**6, ""))

    return rest(0, "", 0)


def test_trie_equals_all_ways():
    rng = random.Random(3)
    names = ["", "blank", "duplicate", "truncated"]
    signatures = sorted({"".join("%x" % rng.choice([rng.randrange(16), 4, 8, 4, 8, 0, 7, 11]) for _ in range(rng.randrange(10))) for _ in range(1500)})
    trie = Trie()
    for s in signatures:
        want = cheapest(tuple(("sua-"[int(x, 16) // 4], names[int(x, 16) % 4]) for x in s))
        assert trie(s) == want, s
        assert told(s)[:3] == tuple(sum(int(x, 16) % 4 == k for x in s) for k in (1, 2, 3))


def test_long_signatures_share_layers():
    trie = Trie()
    long = "48" * 60_000
    assert trie(long) == (0, "K" * 120_000)
    assert trie(long + "4") == (2, "K" * 120_001 + "I")
    assert trie(long + "44") == (2, "K" * 120_001 + "R")


def test_equals_plain_loops(spark):
    rng = random.Random(8)
    texts = ["Hello there.", "Why?", "no end", "", " \t\n", None, "so be it!", "x.y", "ends with space. \n", "Wow! ... ", "é日本.", "word " * 40_000 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "User", "u", "sys"]
    rows = []
    for conv in range(150):
        for turn in range(rng.randrange(1, 12)):
            rows.append((conv, turn + rng.choice([0, 0, 0, 5]), rng.choice(roles[: rng.choice([3, 11])]), rng.choice(texts[: rng.choice([3, 11, 11])])))
    rows += [(200, None, "user", "No turn."), (200, None, "assistant", "None."), (200, 3, "user", "Three."), (201, None, "user", "Only."), (None, 1, "user", "Null."), (None, None, "assistant", "Null.")]
    rows += [(202, 4, "user", "Same.")] * 3 + [(203, 4, r, t) for r, t in (("user", "B."), ("user", "A."), ("assistant", "C."))] + [(204, k, roles[k % 2], texts[11]) for k in range(4)]
    rows += [(300, k, ("user", "assistant")[k % 2], f"Turn {k}.") for k in range(9_000)]
    lost = next(k for k in range(1000, 2000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows.append((lost, 0, "user", "Gone."))
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 7, 1) for r in rows], "conv_id long, turn long, role string, text string, c string, pos int, audit int").repartition(5)
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in repaired(df).collect()}
    want = plain(rows)
    assert set(got) == set(want) and got[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    for conv in want:
        assert got[conv] == want[conv], conv


def test_empty_table(spark):
    assert repaired(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
