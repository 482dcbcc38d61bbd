"""Repeated strings, fill-in-the-middle and conversation tries against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import conversation_trie, fill_middle, suffix_dedup


@given(st.one_of(st.text("ab"), st.text("abc\0"), st.text()).map(lambda x: x.encode("utf-8", "surrogatepass")))
@settings(max_examples=200, deadline=None)
def test_two_stage_order_is_that_of_plain_sorting(text):
    order = suffix_dedup.suffix_order(np.frombuffer(text, np.uint8), max(len(text), 1))
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_order_and_prefixes_of_long_runs_and_copies():
    rng = random.Random(3)
    part = bytes(rng.choice(b"abcde") for _ in range(300))
    text = part + b"a" * 700 + part + b"\0" + part[:150] + b"zz" * 200
    flat = np.frombuffer(text, np.uint8)
    order = suffix_dedup.suffix_order(flat, len(text))
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    shared = suffix_dedup.common_prefixes(suffix_dedup._grams(flat, 120), order, 100)
    for i in range(1, len(order)):
        a, b = (text[j:] + bytes(120) for j in order[i - 1 : i + 1])
        assert shared[i] == next((k for k in range(100) if a[k] != b[k]), 100)


def repeats_removed(docs):
    """(doc_id, text) in order -> (n_bytes, spans, kept) by a set of all windows."""
    seen, out = set(), []
    for text in docs:
        covered = bytearray(len(text))
        for p in range(len(text) - 99):
            if text[p : p + 100] in seen:
                covered[p : p + 100] = b"\1" * 100
            seen.add(text[p : p + 100])
        spans = [m.span() for m in re.finditer(b"\1+", bytes(covered))]
        out.append((len(text), spans, bytes(x for x, c in zip(text, covered) if not c)))
    return out


def check_repeats(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    want = repeats_removed([(t or "").encode() for t in texts])
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(spark, docs).collect()}
    for i, (n, spans, kept) in enumerate(want):
        assert (got[i]["n_bytes"], [tuple(s) for s in got[i]["spans"]], bytes(got[i]["kept"])) == (n, spans, kept), texts[i]
    digests = {r["doc_id"]: r["kept"] for r in suffix_dedup.remove_repeats(spark, docs, digests=True).collect()}
    assert digests == {i: hashlib.sha256(x[2]).hexdigest() for i, x in enumerate(want)}
    return sum(len(x[1]) for x in want)


def test_repeats_equal_brute_force(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "δέλτα", "日本語", "x", "of", "the", "\0", "naïve"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    passages = [prose(30) for _ in range(6)]
    texts = ["", None, "short", "a" * 99, "a" * 100, "a" * 101, "b" * 5000, "ab" * 300, "abc" * 1000, "a" * 100]
    for _ in range(60):
        parts = [prose(rng.randrange(40)) for _ in range(3)]
        parts.insert(1, rng.choice(passages))
        if rng.random() < 0.3:
            line = prose(6)
            parts.insert(0, "\n".join([line] * rng.randrange(2, 9)))
        texts.append(" ".join(parts))
    texts += texts[20:24] + [texts[30] + texts[31]]
    assert check_repeats(spark, texts) > 60


def test_a_line_in_all_texts_among_unlike_ones(spark):
    """Its keys are heavy at every level below its length; nothing but what is whole for 100 bytes goes."""
    rng = random.Random(6)
    line = "this very common line has more than sixty bytes and stands in every text"
    noise = lambda: "".join(rng.choice("abcdefghij ") for _ in range(60))
    ends = [noise() for _ in range(12)]
    texts = [noise() + line + rng.choice(ends) + noise() for _ in range(400)]
    assert check_repeats(spark, texts) > 300


def test_repeated_rows_and_ids_are_defined(spark):
    a, b = "first text " * 30, "second text " * 30
    rows = [(1, a), (1, a), (None, a), (2, b), (2, b + "!"), (3, b)]
    got = suffix_dedup.remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = sorted((str(r["doc_id"]), bytes(r["kept"])) for r in got)
    one = repeats_removed([a.encode()])[0][2]
    assert kept[5] == ("None", one) and kept[0] == kept[1] and len(kept[0][1]) == 0 and kept[4] == ("3", b"")
    assert sorted(len(k) for i, k in kept if i == "2")[-1] > 0


@given(st.text("ab \n<PSM>é😀", max_size=60), st.lists(st.integers(0, 2**32 - 1), min_size=4, max_size=4))
@settings(max_examples=300, deadline=None)
def test_piece_tables_cut_arrange_and_restore(text, h):
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n, form, prefix, middle, table = fill_middle.transformed(text, h)
    assert n == len(units) and "".join(units) == text
    output = table.text()
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:i], units[i:j], units[j:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        assert (form, prefix, middle, output) == ("plain", None, None, text)
    elif h[3] % 100 < 80:
        assert (form, prefix, middle, output) == ("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    else:
        assert (form, prefix, middle, output) == ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")
    assert fill_middle.restored(output, form).text() == text
    assert table.sha256() == hashlib.sha256(output.encode()).hexdigest()


def test_outputs_are_whole_and_repeatable(spark):
    docs = spark.createDataFrame([(i, f"one two  three\n{i} four " * (i + 1)) for i in range(40)] + [(None, "x"), (3, None), (3, None)], "doc_id long, text string").selectExpr("*", "'clash' AS form")
    rows = fill_middle.fill_middle(docs, rate=100).collect()
    assert len(rows) == 43 and {r["form"] for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        assert r["output_sha256"] == hashlib.sha256(r["output"].encode()).hexdigest()
    assert sorted(map(str, rows)) == sorted(map(str, fill_middle.fill_middle(docs.repartition(7), rate=100).collect()))


def test_slots_are_minimal_perfect_and_verified():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(-(2**63), 2**63 - 1, 50_000) for _ in range(2))
    table = conversation_trie.PerfectSlots(a[:40_000], b[:40_000])
    assert sorted(table.own.tolist()) == list(range(40_000))
    assert (table.find(a, b)[:40_000] == table.own).all() and (table.find(a, b)[40_000:] == -1).all()
    assert (table.find(a[:40_000], b[:40_000] ^ 1) == -1).all()


def trie(rows):
    """The nodes of brute force: (conv_id, depth, parent, n_convs, n_children, n_leaves, saved_tokens, ends)."""
    own = {}
    for c, turn, role, text in rows:
        own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(x)] for c, x in own.items()}
    name = lambda c: "" if c is None else str(c)
    members, ends, least = {}, {}, {}
    for c in sorted(own, key=lambda c: (c is not None, c or 0)):
        h = zlib.crc32(name(c).encode()) % 4
        built = (own.get(c - c % 20, [])[:h] if h else []) + own[c][h:]
        for d in range(len(built) + 1):
            members.setdefault(tuple(built[:d]), []).append(c)
        ends.setdefault(tuple(built), []).append(name(c))
    least = {k: v[0] for k, v in members.items()}
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        saved[k] = (len(members[k]) - 1) * words + sum(saved[x] for x in kids.get(k, []))
        leaves[k] = sum(leaves[x] for x in kids[k]) if k in kids else 1
    return sorted(
        (str((least[k], len(k), least[k[:-1]] if k else None, len(v), len(kids.get(k, [])), leaves[k], saved[k], hashlib.sha256(",".join(ends.get(k, [])).encode()).hexdigest())) for k, v in members.items())
    )


def check_trie(spark, rows):
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'clash' AS depth", "1 AS n_convs").repartition(3)
    got = conversation_trie.conversation_trie(spark, data).drop("a", "b").collect()
    assert sorted(str(tuple(r)) for r in got) == trie(rows)
    return got


def test_trie_equals_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for c in [*range(0, 130), *range(1000, 1003)]:
        for t in range(rng.randrange(1, 6)):
            rows.append((c, t, rng.choice(("user", "assistant")), rng.choice(("hi", "hi there", "a\tb  c", "", None))))
    rows += [(7, None, None, "first"), (8, 1, "user", "tie"), (8, 1, "user", "tie"), (None, 0, "user", "hi"), (None, 1, None, None)]
    assert check_trie(spark, rows)


@pytest.mark.parametrize("band", [1024, 16])
def test_heavy_nodes_and_long_conversations_equal_brute_force(spark, monkeypatch, band):
    monkeypatch.setattr(conversation_trie, "LEAST_HEAVY", 20)
    monkeypatch.setattr(conversation_trie, "BAND", band)
    monkeypatch.setattr(conversation_trie, "CHUNK", 8)
    rng = random.Random(4)
    rows = [(c, t, "user", f"same turn {t}") for c in range(3, 120, 2) for t in range(4)]
    rows += [(c, t, "user", rng.choice(("same turn 0", "x", "y z"))) for c in range(0, 120, 2) for t in range(rng.randrange(1, 5))]
    rows += [(c, t, "user" if t % 2 else "assistant", f"turn {t if t < 90 else t * c}") for c in (1, 501, 502) for t in range(130)]
    got = check_trie(spark, rows)
    assert max(r["depth"] for r in got) > 100


def test_no_conversations_no_nodes(spark):
    assert check_trie(spark, []) == []
