"""Vector packing, conversation repair and spelling variants against plain code, on odd tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidepool.llm import conversations, queries, spelling, vector_packing

WORD = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", "  ", "don't WE'LL 's", "<|endoftext|>", "a<|endoftext|> b<|startoftext|>", "a" * 5000, "\x1c a \x1d", "x\x1cy\x1f z", "\xa0 x  y", "😀 é ü", "日本語", "ΑΣ ΟΔΟΣ", "İx", "<|x", "a\x85 b", "word " * 5000, "x", "x"]


def packed(out, tokens, segments, loss):
    """Checks what holds of any packing; pieces by key, and each sequence's length."""
    places, by_key = defaultdict(list), defaultdict(list)
    for r in out:
        assert r.length == len(r.ids)
        places[r.sequence_id].append(r)
        by_key[r.doc_id].append(r)
    for rows in places.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [0, *itertools.accumulate(r.length for r in rows)][:-1]
        assert sum(r.length for r in rows) <= tokens and len(rows) <= segments and sum(r.loss_tokens for r in rows) <= loss
    return by_key, [sum(r.length for r in rows) for rows in places.values()]


@pytest.mark.parametrize("n", [1, 7])
def test_packing_of_texts(spark, n):
    r, t = random.Random(n), Tokenizer.from_file(WORD)
    texts = [*ODD, *(" ".join(r.choice(("ab", "É", "chord.", "x1y")) for _ in range(int(r.paretovariate(0.7)))) for _ in range(400))]
    docs = spark.createDataFrame([(i, x, "s", 1) for i, x in enumerate(texts)], "doc_id bigint, text string, sequence_id string, offset int").repartition(n)
    by_key, lengths = packed(vector_packing.pack(docs, WORD).collect(), 2048, 64, 2048)
    for i, x in enumerate(texts):
        rows = sorted(by_key[i], key=lambda r: r.start)
        want = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        assert [k for r in rows for k in r.ids] == want and {r.doc_tokens for r in rows} == {len(want)}
        assert [r.start for r in rows] == [0, *itertools.accumulate(r.length for r in rows)][:-1]
    assert all(x & (x - 1) == 0 for x in lengths)  # no padding
    assert vector_packing.pack(docs.limit(0), WORD).count() == 0


def test_packing_under_all_limits(spark):
    r, t = random.Random(5), Tokenizer.from_file(WORD)
    chats = [(i, [("tell me " * r.randint(1, 40), False), ("so it is " * r.randint(1, 60), True)] * r.randint(1, 3)) for i in range(150)] + [(150, None), (151, []), (152, [(None, True)])]
    docs = spark.createDataFrame(chats, "doc_id bigint, text array<struct<t:string,l:boolean>>").repartition(3)
    by_key, lengths = packed(vector_packing.pack(docs, WORD, tokens=512, segments=3, loss=200).collect(), 512, 3, 200)
    for i, parts in chats:
        ids, bears = [], []
        for x, loss in parts or []:
            new = t.encode(x or "", add_special_tokens=False).ids
            ids, bears = ids + new, bears + [loss] * len(new)
        ids, bears = [*ids, 1], [*bears, parts[-1][1] if parts else True]
        rows = sorted(by_key[i], key=lambda r: r.start)
        assert [k for p in rows for k in p.ids] == ids
        assert all(p.loss_tokens == sum(bears[p.start + 1 : p.start + p.length]) for p in rows)
    assert all(x & (x - 1) == 0 for x in lengths)
    assert len(lengths) < 1.5 * sum(lengths) / 256  # with so little loss allowed 256 is the greatest power of two that most sequences reach


def test_packing_cuts_little(spark):
    r = random.Random(2)
    packer = vector_packing.Packer(2048, 64, 2048)
    sizes = [r.randint(1, 1500) for _ in range(3000)]
    for k, n in enumerate(sizes):
        packer.add(vector_packing.Example(k, [0] * n))
    made = list(packer.take(0))
    assert sum(b - a for s in made for _, a, b in s) == sum(sizes)
    assert sum(map(len, made)) < 1.4 * len(sizes)  # a cut for each sequence at most, and a few at the end
    assert sum(sum(b - a for _, a, b in s) == 2048 for s in made) >= len(made) - 11


# ---- conversations


def slow_repair(rows):
    """rows: (turn, role, text) in order. Every sequence of edits is tried by plain dynamic programming over role initials."""
    seen, kinds, counts = set(), [], Counter()
    for _, role, text in rows:
        visible = re.findall(r"[^\x20\x09-\x0D]", text)
        blank, again = not visible, (role, text) in seen
        open_ = bool(visible) and visible[-1] not in ".!?"
        counts["blank" if blank else "duplicate" if again else "truncated" if open_ else "fine"] += 1
        kinds.append((blank or again, open_))
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    legal = re.compile(r"(s?(ua)*u?)?")
    best = {}  # initials' state to the best of (cost, audit, made)

    def state(initials):
        return initials[-1:] if initials != "s" else "s"

    def offer(table, made, cost, audit):
        initials = "".join(m[0][:1] if m[0] else "?" for m in made)
        if legal.fullmatch(initials):
            key = state(initials)
            if key not in table or (cost, audit) < table[key][:2]:
                table[key] = (cost, audit, made)

    def with_insertions(table):
        for _ in range(3):
            for cost, audit, made in list(table.values()):
                for role in ("user", "assistant"):
                    offer(table, [*made, (role, "")], cost + 2, audit + "I")
        return table

    offer(best, [], 0, "")
    best = with_insertions(best)
    for (_, role, text), (gone, open_) in zip(rows, kinds, strict=True):
        new = {}
        for cost, audit, made in best.values():
            offer(new, made, cost + 3, audit + "D")
            if not gone:
                offer(new, [*made, (role, text)], cost + open_, audit + "K")
                for other in ("user", "assistant"):
                    offer(new, [*made, (other, text)], cost + 2 + open_, audit + "R")
        best = with_insertions(new)
    cost, audit, made = min(x for k, x in best.items() if k in ("", "a"))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def chats(r, n, longest=9):
    for c in range(n):
        for _ in range(r.randint(1, longest)):
            turn = r.choice([*range(12), None])
            role = r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            yield c if c else None, turn, role, r.choice(["Yes.", "no", "", " \n", None, "What?", "é… ", "ok! ", "So it is.\t", f"{r.random()}."])


def found(spark, rows, kinds="conv_id bigint, turn bigint, role string, text string"):
    return conversations.Repair(spark.createDataFrame(rows, kinds).repartition(3))


def compared(spark, rows):
    fix = found(spark, rows)
    digests = {r.conv: r.sha256 for r in fix.transcripts().collect()}
    got = {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digests.get(r.conv, hashlib.sha256(b"").hexdigest())) for r in fix.conversations.collect()}
    want = defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((t, " " if role is None else role, " " if text is None else text))
    assert got == {c: slow_repair(in_order(own)) for c, own in want.items()}


def test_repair_of_odd_conversations(spark):
    compared(spark, list(chats(random.Random(1), 250)))


def test_repair_in_small_chunks(spark, monkeypatch):
    # conversations over many chunks are put together from charts, one of them far longer than the others
    monkeypatch.setattr(conversations, "CHUNK_BITS", 2)
    r = random.Random(2)
    rows = list(chats(r, 40, 30)) + [(99, i, r.choice(["user", "assistant", "system"]), r.choice(["a.", "b", "", f"{i}!"])) for i in range(300)] + [(99, 7, "user", "a.")] * 50
    compared(spark, rows)


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "assistant", "Hi."), (1, 2, "user", "Why?"), (1, 3, "assistant", "So.")]
    turns = [(r.role, r.text) for r in found(spark, rows).turns().orderBy("place", "nth").collect()]
    assert turns == [("user", ""), ("assistant", "Hi."), ("user", "Why?"), ("assistant", "So.")]
    assert conversations.Repair(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").limit(0)).conversations.count() == 0


def test_op12_damage(spark, tmp_path):
    rows = list(chats(random.Random(3), 200))
    spark.createDataFrame([(*x, 1) for x in rows], "conv_id bigint, turn bigint, role string, text string, audit int").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, str(tmp_path)).collect()}
    want = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            want[c] += [(t, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    assert got == {c: slow_repair(in_order(own)) for c, own in want.items()}


# ---- spelling


def slow_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_groups(counts):
    out, forms = {}, {}
    for w, n in counts.items():
        near = [(-m, x) for x, m in counts.items() if abs(len(x) - len(w)) < 2 and slow_near(w, x)]
        m, x = min(near, default=(0, None))
        forms[w] = x if near and -m >= 10 * n else None
        out[w] = [forms[w], n, len(near), -m if forms[w] else None]
    for w, row in out.items():
        root = w
        while forms[root]:
            root = forms[root]
        row.insert(1, root)
    return {w: tuple(x) for w, x in out.items()}


def spelled(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_groups_of_words(spark, monkeypatch):
    r = random.Random(4)
    base = ["".join(r.choice("abé") for _ in range(r.randint(7, 9))) for _ in range(150)] + ["aaaaaaaa", "aaaaaaa", "aaaaaaaaa", "ÿ" * 300, "ÿ" * 299 + "a", "ÿ" * 301, "b" * 64, "b" * 65, "b" * 63 + "a"]
    words = {w: int(10 ** r.uniform(0.4, 5)) for w in base}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint").repartition(4)
    assert spelled(spelling.grouped(df)) == slow_groups(words)
    monkeypatch.setattr(spelling, "LONG", 7)
    monkeypatch.setattr(spelling, "GROUPED", 50)
    assert spelled(spelling.grouped(df)) == slow_groups(words)
    assert spelling.grouped(df.limit(0)).count() == 0


def test_equal_hashes_of_different_words():
    rows = list(spelling.met([0, 0, ~1, spelling.ITSELF], ["xabc", "yabd", "pqr", "prz"], [5, 6, 1, 2]))
    assert rows == []


def test_op13(spark, tmp_path):
    r = random.Random(6)
    vocabulary = ["".join(r.choice("abcÉé") for _ in range(r.randint(5, 9))) for _ in range(60)]
    texts = [None, "", "  ", "don't", "abcabca×bcabc abcabcabc_abcabca1abcabca", *(" ".join(r.choice(vocabulary[: int(1 + 60 * r.random() ** 3)]) for _ in range(200)) for _ in range(60))]
    rows = [(None if i == 7 else i, t) for i, t in enumerate(texts)] + [(9, texts[9]), (3, "ABCABCAÉ")] * 2
    spark.createDataFrame([(i, t, "x", 2) for i, t in rows], "doc_id bigint, text string, word string, n int").write.parquet(f"{tmp_path}/documents.parquet")
    counts: Counter = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    want = slow_groups({w: n for w, n in counts.items() if len(w) >= 7 and n >= 2})
    assert spelled(queries.op13_spelling_variants(spark, str(tmp_path))) == want and any(x[0] for x in want.values())
