"""Methods against brute force, libraries and exact round trips."""

import array
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF
from weftline.llm import chat_format, language_id, maxent_lm, mtree_search, order_minhash, packing, pieces, pii, toxicity, weighted_sampling
from weftline.llm.textarrays import blocks
from weftline.llm.word_ids import WordIds
from weftline.llm.wordhash import word_hashes


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# -- language ---------------------------------------------------------------


def test_language_accuracy_on_held_out_documents(spark):
    got = language_id.op1_language_id(spark, SF).where("held_out").join(documents(spark).select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 30 and right > 0.95


def test_filter_returns_all_languages_that_hold_a_gram():
    counts = {"aa": {"x": 50}, "bb": {"x": 40, "y": 60}}
    filters = language_id.Filters(["x", "y"], np.zeros((1 << language_id.SLOT_BITS, 1), dtype=np.int64), np.zeros(2))
    grams = {w: language_id.trigrams([w])[0] for w in counts}
    for w, langs in counts.items():
        for i, lang in enumerate("xy"):
            if lang in langs:
                for k in range(language_id.HASHES):
                    filters.masks[((grams[w] >> np.uint64(21 * k)) & np.uint64((1 << language_id.SLOT_BITS) - 1)).astype(int), 0] |= 1 << i
    assert set(language_id._lookup(filters, grams["aa"])[:, 0]) == {1}
    assert set(language_id._lookup(filters, grams["bb"])[:, 0]) == {3}


def test_decisions_equal_a_plain_count(spark):
    """Each document's language and score, from the learned filters, one n-gram at a time."""
    docs = documents(spark)
    filters = language_id.fit_on_documents(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.op1_language_id(spark, SF).collect()}
    known = {}

    def holds(a, b, c):
        if (a, b, c) not in known:
            gram = language_id.mix(np.asarray([(a << 42) | (b << 21) | c], dtype=np.uint64))[0]
            mask = -1
            for k in range(language_id.HASHES):
                mask &= int(filters.masks[int(gram >> np.uint64(21 * k)) & ((1 << language_id.SLOT_BITS) - 1), 0])
            known[a, b, c] = mask
        return known[a, b, c]

    for r in docs.collect()[:120]:
        low = [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 0 for c in f" {r['text'] or ''} "]
        masks = [holds(*low[i - 1 : i + 2]) for i in range(1, len(low) - 1) if low[i]]
        if not masks:
            assert got[r["doc_id"]] == ("und", 0.0)
            continue
        counts = [max(0.0, (sum(m >> i & 1 for m in masks) - len(masks) * f) / (1 - f)) for i, f in enumerate(filters.false_rate)]
        best = max(range(len(counts)), key=lambda i: (counts[i], -i))
        assert got[r["doc_id"]] == (filters.languages[best], pytest.approx(min(1.0, counts[best] / len(masks)), abs=1e-9))


@pytest.mark.parametrize("text", ["recycling trash " * 200_000, "ab" * 1_500_000])
def test_texts_of_millions_of_letters_are_whole(text):
    a = toxicity.Lexicon({" trash ": 2.0, " ba": 1.0}, ["recycling trash"]).automaton()
    assert toxicity.features(a, [text, "trash"])[:, 0].tolist() == [0.0, 2.0]
    assert len(language_id.trigrams([text])[0]) == sum(c.isalpha() for c in text)
    (rows, parts), *more = blocks([text, "x"])
    assert parts == [text] and rows.tolist() == [0] and [p for _, p in more] == [["x"]]


def test_trigrams_do_not_depend_on_what_stands_beside():
    alone = [language_id.trigrams([t])[0].tolist() for t in ("Ab c", "", "ça va")]
    together, n = language_id.trigrams(["Ab c", "", "ça va"])
    assert together.tolist() == sum(alone, []) and n.tolist() == [len(x) for x in alone]


# -- personal data ----------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_those_of_the_plain_patterns(spark):
    rng = random.Random(4)
    bits = "a@b.c|.d|@|-|_|x.y|1.2.3.4|255|.|256.|4111111111111111|4111 1111-1111 1111|+1 (555) 555-1234|+|( | |9|00|é|😀||1|2|a|@mail.example.com|\n|%".split("|")
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts += ["", "1" * 50_000, "a." * 30_000 + "@b" + ".c" * 30_000, "1 " * 30_000, "a" * 100_000, "+1 " * 20_000]
    found = {r["row"]["doc_id"]: r for r in pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert [(s["start"], s["kind"], s["end"]) for s in found[i]["base"]] == base_spans(t), t[:200]


def test_reliabilities_prefer_the_labelers_that_agree():
    counts = {(4, (1, 1, 1)): 80.0, (4, (1, 1, -1)): 20.0, (4, (-1, -1, 1)): 15.0, (4, (-1, -1, -1)): 60.0}
    p = pii.fit_reliabilities(counts)
    assert p[(4, (1, 1, -1))] > 0.9 and p[(4, (-1, -1, 1))] < 0.1


def test_long_texts_with_many_matches(spark):
    """Spans and redaction over block and page borders, against plain loops."""
    rng = random.Random(12)
    bits = ["mail é%d@b.cd", "10.0.%d.7", "+1 (555) 555-%04d", "wörd wörd %d", "4111 1111 1111 1111 %d", "😀 %d\n", "+4111 1111 1111 11%d"]
    text = " ".join(rng.choice(bits) % rng.randrange(10**4) for _ in range(6_000)) + "x" * 5_000 + " a@b.cd"
    docs = spark.createDataFrame([(1, text), (2, "a@b.cd"), (3, "")], "doc_id long, text string")
    base = base_spans(text)
    assert len(base) > 1_000
    got = {r["doc_id"]: r for r in docs.join(pii.find_spans(docs).select("row.doc_id", "base"), "doc_id").withColumn("clean", pii.redact(F.col("text"), F.col("base"))).collect()}
    assert [(s["start"], s["kind"], s["end"]) for s in got[1]["base"]] == base
    out, at = [], 0
    for start, kind, end in base:
        if start >= at:
            out += [text[at:start], f"[{pii.KINDS[kind].upper()}]"]
        at = max(at, end)
    assert got[1]["clean"] == "".join(out) + text[at:]
    assert (got[2]["clean"], got[3]["clean"]) == ("[EMAIL]", "")


def test_added_kinds_on_planted_data(spark):
    """Precision and recall of the added spans in four languages; decoys look alike but aren't personal."""
    rng = random.Random(8)
    filler = {"en": "the house of a man and his dog", "de": "das haus der frau und ihr hund", "fr": "la maison de cet homme et son chien", "es": "la casa de este hombre y su perro"}
    words = {"en": ("token", "card", "phone"), "de": ("passwort", "konto", "telefon"), "fr": ("clé", "compte", "téléphone"), "es": ("contraseña", "cuenta", "teléfono")}
    titles = {"en": "Mr. John Smith", "de": "Frau Erika Müller", "fr": "Mme Zoé Lefèvre", "es": "Señora Ana Núñez"}
    rows, want = [], set()
    for i in range(400):
        lang = rng.choice(list(filler))
        parts, at = [], 0
        for _ in range(3):
            secret = "".join(rng.choice("0123456789abcdef") for _ in range(40))
            kind, lead, value = rng.choice(
                [
                    ("secret", f'{words[lang][0]} = "', secret), ("account", f"{words[lang][1]}: ", f"{rng.randrange(10**7, 10**8)}00000000"), ("local_phone", f"{words[lang][2]}: ", f"({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"),
                    ("person", "", titles[lang]), (None, rng.choice(["sha ", "commit ", "checksum/"]), secret), (None, "", "long_" + "plain-word-" * 4),
                ]
            )
            if kind == "account" and luhn(value):
                value = value[:-1] + "1"
            before = filler[lang] + " " + lead
            if kind:
                want.add((i, kind, at + len(before), at + len(before) + len(value)))
            piece = before + value + ('" ' if lead.endswith('"') else " ")
            parts.append(piece)
            at += len(piece)
        rows.append((i, "".join(parts)))
    found = pii.detect(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r["row"]["doc_id"], pii.KINDS[s["kind"]], s["start"], s["end"]) for r in found.collect() for s in r["added"]}
    for kind in pii.ADDED:
        g, w = ({x for x in y if x[1] == kind} for y in (got, want))
        assert len(g & w) >= 0.9 * len(w), (kind, len(g & w), len(w))
        assert len(g & w) >= 0.9 * len(g), (kind, len(g & w), len(g))


def test_redaction_replaces_every_span(spark):
    docs = spark.createDataFrame([(1, "a@b.cd and 10.0.0.1, é +1 (555) 555-1234."), (2, None), (3, "nothing")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redacted(spark, docs).collect()}
    assert got == {1: "[EMAIL] and [IP], é [PHONE].", 2: None, 3: "nothing"}


# -- chat -------------------------------------------------------------------


@settings(max_examples=3, deadline=None)
@given(st.data())
def test_chat_round_trip(spark, data):
    bits = ["</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_sep|>", "<|im_end|>", "&lt;", "&amp;", "&", "<", "[", "\n", "a", "é"]
    turns = data.draw(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a\nb", "<|im_end|>"]), st.lists(st.sampled_from(bits), max_size=6).map("".join)), min_size=1, max_size=40))
    rows = spark.createDataFrame([(1, i * 100, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    out = chat_format.with_loss(chat_format.format_conversations(rows)).withColumn("turns", chat_format.read_turns(F.col("formatted"))).first()
    assert [(t["role"], t["text"]) for t in out["turns"]] == turns
    assert out["loss"] == "".join(t for r, t in turns if r == "assistant")
    assert "</s>" not in out["formatted"] and "[INST]" not in out["formatted"]


def test_tied_turns_follow_their_raw_role_and_text(spark):
    rows = [(1, 5, "user", t) for t in ("<s>", "(x", ";", "&lt;", "[INST]", "\n")] + [(1, 5, r, "t") for r in ("a", "<s>", "B")] + [(2, None, "user", f"<s>{i}") for i in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_conversations(df).withColumn("turns", chat_format.read_turns(F.col("formatted"))).collect()
    for r in out:
        assert [(t["role"], t["text"]) for t in r["turns"]] == sorted((a, b) for c, _, a, b in rows if c == r["conv_id"])


# -- fingerprints -----------------------------------------------------------


def test_collision_rate_is_the_generalised_jaccard_similarity():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    errors = []
    for _ in range(60):
        a = [rng.choice(vocabulary) for _ in range(200)]
        b = a[: rng.randint(0, 200)]
        b += [rng.choice(vocabulary) for _ in range(200 - len(b))]
        number, term, weight = weighted_sampling.weighted_terms([" ".join(a), " ".join(b)])
        x, y = ({t: w for t, w, n in zip(term.tolist(), weight.tolist(), number) if n == k} for k in (0, 1))
        truth = sum(min(x.get(k, 0), y.get(k, 0)) for k in x.keys() | y.keys()) / sum(max(x.get(k, 0), y.get(k, 0)) for k in x.keys() | y.keys())
        f = weighted_sampling.fingerprints([" ".join(a), " ".join(b)])
        errors.append(weighted_sampling.likeness(f[:1], f[1:])[0] - truth)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.1


def test_likeness_does_not_depend_on_a_length():
    """One more character at any length about 200 moves the likeness as little as anywhere else."""
    rng = random.Random(3)
    means = []
    for length in range(190, 211):
        likes = []
        for _ in range(30):
            text = " ".join(f"{rng.randrange(16**4):04x}" for _ in range(50))[:length]
            f = weighted_sampling.fingerprints([text, text + "z"])
            likes.append(weighted_sampling.likeness(f[:1], f[1:])[0])
        means.append(np.mean(likes))
    assert min(means) > 0.85 and max(abs(a - b) for a, b in zip(means, means[1:])) < 0.1


def test_edited_texts_follow_the_order_of_ids(spark):
    got = {r["doc_id"]: r for r in weighted_sampling.op4_fingerprints(spark, SF).collect()}
    rows = sorted(((r["doc_id"], r["text"] or "") for r in documents(spark).collect()), reverse=True)
    for (i, a), (_, b) in zip(rows, rows[1:] + rows[:1]):
        assert got[i]["edited_sha256"] == hashlib.sha256(weighted_sampling.edited(a, b).encode()).hexdigest()
    assert np.mean([r["near_edited"] > r["near_next"] for r in got.values()]) > 0.95


def test_any_number_of_ranges_gives_the_chain_of_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices("ab cd ef gh ij".split(), k=rng.randint(0, 9)))) for i in rng.sample(range(10**6), 700)]
    rows += [(None, f"no id {i}") for i in range(200)] + [(77, f"same id {i}") for i in range(200)] + [(rows[0][0], rows[0][1])] * 5 + [(5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).collect()
    ordered = sorted(ordered, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["h"], r["text"]))
    want = sorted(
        (str(a["doc_id"]), len(a["text"]), hashlib.sha256(weighted_sampling.edited(a["text"], b["text"]).encode()).hexdigest())
        for a, b in zip(ordered, ordered[1:] + ordered[:1])
    )
    for ranges in (1, 24, None):
        out = weighted_sampling.fingerprint_documents(spark, docs, ranges)
        assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in out.collect()) == want


# -- toxicity ---------------------------------------------------------------


@pytest.mark.parametrize("text", ["TRA5H", "тrаsh", "tr@sh!!", "ｔｒａｓｈ", "tra$h"])
def test_folding_finds_disguised_words(text):
    a = toxicity.Lexicon({" trash ": 2.0}).automaton()
    assert toxicity.features(a, [f"so {text} it is"])[0].tolist() == [2.0, 4.0]


def folded_word(word):
    """The rule of one word without arrays: letters and substitutes from the first to the last, number-like ends left out."""
    out = [toxicity.SUBSTITUTES.get(c, c.lower()) for c in word]
    at = [i for i, c in enumerate(word) if c.isalpha()]
    if not at:
        return ""
    a, b = at[0], at[-1] + 1
    start = a if word[:a].isdigit() and a >= len(word) - a else 0
    end = b if word[b:].isdigit() and len(word) - b < b else len(word)
    return "".join(out[start:end])


@pytest.mark.parametrize(
    "text, want",
    [("@ss", "ass"), ("$hit", "shit"), ("5hit", "shit"), ("h3110", "heiio"), ("b4574rd", "bastard"), ("1diot", "idiot"), ("1d10t", "idiot"), ("id10t", "idiot"), ("5tup1d", "stupid"), ("$tupid", "stupid"),
     ("a$$", "ass"), ("covid19", "covid"), ("mp3", "mp"), ("10km", "km"), ("1357", ""), ("$5", ""), ("x" + "4" * 50 + "y", "x" + "a" * 50 + "y")],
)
def test_substitutes_count_from_both_sides_and_numbers_do_not(text, want):
    assert toxicity.fold_texts([text])[0].strip() == want == folded_word(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab01345@$", min_size=1, max_size=9), max_size=6))
def test_folding_equals_the_rule_for_single_words(words):
    text, _, n = toxicity.fold_texts([" ".join(words)])
    assert text.split() == [w for w in map(folded_word, words) if w] and n[0] == len(text.split())


def test_exceptions_cancel_hits_and_numbers_stay_numbers():
    a = toxicity.Lexicon({" trash ": 2.0, " tra": 1.0}, ["recycling trash"]).automaton()
    assert toxicity.features(a, ["recycling trash, trash and 1357"])[0].tolist() == [2.0, 4.0]
    assert toxicity.features(a, ["traction"])[0].tolist() == [1.0, 1.0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["tra", "trash", "recycling", "x", "trashes", "tr4sh", ","]), max_size=12), min_size=1, max_size=4))
def test_matches_equal_a_plain_search(texts):
    lexicon = toxicity.Lexicon({" trash ": 2.0, " tra": 1.0, " x ": 0.5}, ["recycling trash", "x x"])
    texts = [" ".join(t) for t in texts]
    want = []
    for t in texts:
        words = re.findall(r"[a-z]+|,", t.replace("4", "a"))
        total = 0.0
        for i, w in enumerate(words):
            pair = i and words[i - 1] != "," and " ".join(words[i - 1 : i + 1]) in lexicon.exceptions
            follows = i + 1 < len(words) and " ".join(words[i : i + 2]) in lexicon.exceptions
            if not pair and not follows:
                total += max([v for k, v in lexicon.weights.items() if f" {w} ".startswith(k)], default=0.0)
        want.append(total)
    assert toxicity.features(lexicon.automaton(), texts)[:, 0].tolist() == pytest.approx(want)


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op5_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("toxic", "predicted").collect()
    toxic, clean = ([r["predicted"] for r in got if r["toxic"] == k] for k in (1, 0))
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.02


# -- packing ----------------------------------------------------------------


def least_bins(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in set(bins):
            if room + items[i] <= capacity:
                k = bins.index(room)
                bins[k] += items[i]
                place(i + 1, bins)
                bins[k] -= items[i]
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best[0] if items else 0


@settings(max_examples=300, deadline=None)
@given(st.integers(4, 20).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=8))))
def test_reduction_keeps_the_optimum_and_plans_are_whole(case):
    capacity, items = case
    counts = Counter(items)
    fixed, rest = packing.reduce_counts(counts, capacity)
    assert sum(k for _, k in fixed) + least_bins(list(Counter(rest).elements()), capacity) == least_bins(items, capacity)
    plan = packing.plan_packing(counts, capacity)
    lengths = np.array([x for x in sorted(counts) for _ in range(counts[x])], dtype=np.int64)
    ranks = np.array([i for x in sorted(counts) for i in range(counts[x])], dtype=np.int64)
    if len(items):
        used = defaultdict(list)
        for length, s, o in zip(lengths, *packing.place(plan, lengths, ranks)):
            used[s].append((o, length))
        for parts in used.values():
            assert [o for o, _ in sorted(parts)] == np.concatenate([[0], np.cumsum([n for _, n in sorted(parts)])[:-1]]).tolist()
            assert sum(n for _, n in parts) <= capacity
        assert len(used) == plan.sequences


def test_plans_stay_small_whatever_the_counts():
    for counts in ({1000: 40_000, 500: 40_000}, {1100: 10**9, 500: 10**9 + 7, 400: 3}, {700: 10**6, 650: 10**6, 600: 10**6, 90: 5}, {1024: 5, 1000: 10**9, 30: 10**9}):
        plan = packing.plan_packing(counts, 2048)
        assert len(plan.lengths) < 1_000
        assert plan.sequences >= sum(k * n for k, n in counts.items()) / 2048
        used = Counter()
        for length, first, each in zip(plan.lengths, plan.first_rank, plan.per_sequence):
            used[length] = max(used[length], first + each)
        assert all(used[k] <= n for k, n in counts.items())


def test_word_ids_equal_the_library():
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        words = WordIds(f.read())
    rng = random.Random(2)
    bits = ["a", "b", "the", " ", "  ", "\n", "é", "é", "́", "日", "😀", "x" * 30, "'s", "'", "ll", "<|endoftext|>", "\t", "\x1c", "\u0085", "İ", "ß", "ΑΣ", "1", ".", "!!", "ﬁ", "À"]
    for _ in range(2000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 20)))
        assert list(array.array("I", words.ids(t))) == words.library.encode(t, add_special_tokens=False).ids, t


def test_pieces_equal_the_library_and_few_sequences(spark):
    rows = packing.op6_packing(spark, SF).collect()
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        library = WordIds(f.read()).library
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["piece"]):
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for d in documents(spark).collect():
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids + [0]
        assert got[d["doc_id"]] == [(k, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert len({r["sequence_id"] for r in rows}) <= math.ceil(sum(r["length"] for r in rows) / 2048) + 1


# -- language model ---------------------------------------------------------


@pytest.mark.parametrize("head", [1 << 20, 3000])
def test_base_scores_and_a_better_model(spark, monkeypatch, head):
    monkeypatch.setattr(maxent_lm, "HEAD", head)
    got = {r["doc_id"]: r for r in maxent_lm.op7_maxent_lm(spark, SF).collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate(lower)) + [None] for r in documents(spark).collect()}
    counts = Counter()
    for i, words in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(words)
    n, v = sum(counts.values()), len(counts)
    for i, words in texts.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), rel=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_every_training_document_teaches_and_probabilities_add_up_to_one(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{min(rng.randrange(3000), rng.randrange(3000))}" for _ in range(rng.randint(0, 80))) for _ in range(400)]
    train = spark.createDataFrame(list(enumerate(texts)) + [(None, None)], "doc_id long, text string")
    counts = maxent_lm.count_tokens(spark, train)
    model = maxent_lm.fit(spark, train, counts)
    e = maxent_lm.events(model, texts)
    rows = np.unique(maxent_lm._class_rows(e.features))
    assert model.class_weights[rows].any(axis=1).all()
    vocabulary = sorted({w for t in texts for w in t.split()}) + ["unseen"]
    n = Counter(w for t in texts for w in t.split())
    for history in ("w1 w2", "w2900 w3", "new words"):
        e = maxent_lm.events(model, [f"{history} {w}" for w in vocabulary] + [history])
        third = np.cumsum(e.per_text) - e.per_text + 2  # of the history alone: its end
        p = np.exp(maxent_lm.log_probabilities(model, e))[third]
        share = np.asarray([(n[w] + 1) / (model.other_total + model.other_distinct + 1) for w in vocabulary] + [1.0])
        assert np.where(e.cls[third] == maxent_lm.CLASSES, share, 1.0) @ p == pytest.approx(1, rel=1e-4)


def test_scores_do_not_depend_on_partitions_and_equal_a_plain_loop(spark, monkeypatch):
    """The same rows in 1, 3 and 12 partitions; then each score again from the learned tables, token by token."""
    from weftline.llm.textarrays import mix

    monkeypatch.setattr(maxent_lm, "SHARD", 5_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = []
    for parts in (1, 3, 12):
        some = docs.repartition(parts)
        train = some.where("doc_id % 7 <> 2")
        counts = maxent_lm.count_tokens(spark, train)
        model = maxent_lm.fit(spark, train, counts)
        got.append({r["doc_id"]: r["score"] for r in maxent_lm.score(spark, some, model, counts).collect()})
    for other in got[1:]:
        assert other == pytest.approx(got[0], abs=1e-3)
    count = {r["token"]: r["c"] for r in counts.collect()}
    known = sorted(count, key=lambda t: (-count[t], t & (2**64 - 1)))
    rank = {t: i for i, t in enumerate(known)}
    inner = maxent_lm.CLASSES * maxent_lm.CLASS_SIZE
    other_total, other_distinct = sum(count[t] for t in known[inner:]), max(0, len(known) - inner)

    def hashed(x):
        return int(mix(np.array([x & (2**64 - 1)], np.uint64))[0])

    def log_share(bias, weights, rows, at):
        z = [float(bias[i]) + sum(float(weights[r][i]) for r in rows) for i in range(len(bias))]
        top = max(z)
        return z[at] - top - math.log(sum(math.exp(v - top) for v in z))

    rows = [r for r in docs.orderBy("doc_id").limit(12).collect()]
    for r in rows:
        token, rare, _ = maxent_lm.tokens([r["text"] or ""])
        total, seen = 0.0, []
        for t, form in zip(token.view(np.int64).tolist(), rare.tolist()):
            at = rank.get(t, inner)
            cls = at // maxent_lm.CLASS_SIZE if at < inner else maxent_lm.CLASSES
            one, two = seen[-1] if seen else 11, seen[-2] if len(seen) > 1 else 13
            features = [hashed(one + 1), hashed(two + 0x632BE59BD9B4E019), hashed(one * 3 + two * 0x9E3779B97F4A7C15)]
            total += log_share(model.class_bias, model.class_weights, [f % maxent_lm.CLASS_ROWS for f in features], cls)
            if cls < maxent_lm.CLASSES:
                places = [((f >> 20) + cls * 0x9E3779B1) % maxent_lm.WORD_ROWS for f in features]
                total += log_share(model.word_bias[cls], model.word_weights, places, at % maxent_lm.CLASS_SIZE)
            else:
                total += math.log((count.get(t, 0) + 1) / (other_total + other_distinct + 1))
            seen.append(t & (2**64 - 1) if at < inner else form)
        assert got[2][r["doc_id"]] == pytest.approx(total / math.log(10), rel=1e-4)


def test_pairwise_sums_equal_plain_ones():
    g = np.random.Generator(np.random.PCG64(2))
    lengths = g.integers(1, 40, 50)
    starts = np.cumsum(lengths) - lengths
    rows = g.random((lengths.sum(), 3))
    assert np.allclose(maxent_lm._summed(rows.copy(), starts, lengths), np.add.reduceat(rows, starts, axis=0))


def test_head_finds_what_it_holds():
    g = np.random.Generator(np.random.PCG64(1))
    keys = g.integers(0, 1 << 63, 5000).astype(np.uint64)
    head = maxent_lm.Head(keys, np.arange(5000)[::-1])
    assert (head.find(keys) == np.arange(5000)).all() and (head.find(keys + np.uint64(1)) == -1).all()


# -- pieces -----------------------------------------------------------------


@pytest.fixture(scope="module")
def models():
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = pieces.PieceModel(pieces.read_model(path))
    return model, sentencepiece.SentencePieceProcessor(model_file=path)


def test_encoding_decoding_and_spans_equal_the_library(models):
    model, library = models
    known = pieces._Remembered(model)
    rng = random.Random(1)
    bits = ["a", "b", "the", " ", "  ", "   ", "\n", "é", "▁", "日", "😀", "梦", ".", "x" * 30, " " * 17, " " * 40, "<s>", "<0x0A>", "\t", "ê", "́", "\x00", "Σ"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    texts += [" " * n + w for n in (1, 2, 3, 5, 16, 17, 33, 100, 1000) for w in ("", "hello", "é", "\n")]
    for t in texts:
        ids, start, stop = model.encode(t)
        assert ids == library.encode(t) and model.decode(ids) == library.decode(ids), t
        n, a, b, spans = pieces.digests(model, known, t)
        assert (n, a, b) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert spans == zlib.crc32(np.asarray(stop).astype("<u4").tobytes())
        if ids:
            assert start[0] == 0 and stop[-1] == len(t.encode()) and (start[1:] == stop[:-1]).all()


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
def test_compiled_maps_normalise_like_the_library(rule):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    model = pieces.PieceModel(library.serialized_model_proto())
    rng = random.Random(3)
    bits = ["a", "B", " ", "  ", "\n", "é", "▁", "ｱ", "①", "ﬁ", "Å", "Ⅳ", "㍿", "　", "が", "ﾊﾞ", "😀", "́"]
    for _ in range(400):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 20)))
        text, at = model.normalize(t)
        assert text == library.normalize(t), t
        assert len(at) == len(text) + 1 and (np.diff(at) >= 0).all()


# -- search -----------------------------------------------------------------


def test_search_skips_pages_and_stays_exact(spark):
    g = np.random.Generator(np.random.PCG64(7))
    centres = g.normal(size=(12, 8)) * 4
    x = np.floor(256 * (centres[g.integers(0, 12, 3000)] + 0.05 * g.normal(size=(3000, 8))).astype(np.float32).astype(float))
    x[1500:1800] = x[0]  # a large group of equal vectors
    rows = spark.createDataFrame([(i, v) for i, v in enumerate((x / 256).tolist())], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in mtree_search.top_k(spark, rows).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 3000, 50):
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(3000), -s)) if i != q][:5]
        assert sorted(got[q]) == [(k + 1, i, int(s[i])) for k, i in enumerate(order)]


def test_scores_of_large_components_and_uneven_lengths_are_exact(spark):
    rng = random.Random(2)
    x = [[rng.randrange(-(2**28), 2**28) for _ in range(rng.choice([4, 4, 3]))] for _ in range(400)]
    for i in range(100, 140):  # nearly equal scores, told apart by their last digits only
        x[i] = [2**28, 2**28, 2**28 - i % 7, 2**28 - 2 * (i % 5)]
    rows = spark.createDataFrame([(i, [c / 256 for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in mtree_search.top_k(spark, rows, every=10).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 400, 10):
        scores = sorted((-sum(a * b for a, b in zip(x[q], v)), i) for i, v in enumerate(x) if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]


# -- near-duplicates --------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=15), st.lists(st.integers(0, 5), max_size=15))
def test_alignment_is_the_longest_common_subsequence(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    assert order_minhash.aligned(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64), 20) == d[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14), st.integers(0, 4))
def test_alignment_stays_in_its_band(a, b, band):
    # the common head and tail go first and are matched on their own
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    x, y = a[head:], b[head:]
    tail = next((i for i, (u, v) in enumerate(zip(x[::-1], y[::-1])) if u != v), min(len(x), len(y)))
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    d = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, u in enumerate(x):
        for j, v in enumerate(y):
            d[i + 1][j + 1] = d[i][j] + 1 if u == v and abs(i - j) <= band else max(d[i][j + 1], d[i + 1][j])
    best = max(max(row) for row in d)
    assert order_minhash.aligned(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64), band) == head + tail + best


def test_rows_of_one_id_with_unlike_texts_are_told_apart(spark):
    rng = random.Random(1)

    def text():
        return [f"w{rng.randrange(10**6)}" for _ in range(120)]

    def near(words):
        return " ".join([*words[:60], "changed", *words[61:]])

    x, y, z, lone = text(), text(), text(), text()
    rows = [(5, " ".join(x)), (5, " ".join(y)), (6, near(x)), (7, near(y)), (None, " ".join(z)), (None, near(z)), (8, " ".join(lone)), (8, " ".join(lone)), (None, near(lone)), (9, None), (10, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k1", F.lit("clash"))
    got = sorted(((r["doc_id"], r["class_id"]) for r in order_minhash.near_classes(spark, docs).collect()), key=str)
    assert got == sorted([(5, 5), (5, 5), (6, 5), (7, 5), (None, None), (None, None), (8, 8), (8, 8), (None, 8), (9, 9), (10, 9)], key=str)
    kept = order_minhash.one_of_each(spark, docs)
    assert kept.columns == docs.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert [r for r in kept if r[0] is not None] == sorted([rows[0], rows[1], rows[6], rows[9]], key=str)
    assert [r for r in kept if r[0] is None] in ([rows[4]], [rows[5]])


def test_very_long_near_copies_are_aligned_in_a_moving_window():
    rng = np.random.Generator(np.random.PCG64(6))
    a = rng.integers(0, 5_000, 200_000).astype(np.uint64)
    b = np.delete(a, rng.choice(len(a), 300, replace=False))
    start = time.monotonic()
    assert order_minhash.similar(a, b) and not order_minhash.similar(a, rng.permutation(a))
    assert time.monotonic() - start < 30


@pytest.mark.parametrize("share", [0.84, 0.9])
def test_recall_on_a_group_of_a_thousand_copies(spark, share):
    """One text's copies, each edited on its own: those at 0.8 or more of another are in its class."""
    rng = random.Random(int(share * 100))
    base = [f"b{i}" for i in range(300)]
    docs = []
    for k in range(1_000):
        words = list(base)
        for _ in range(int((1 - share) / 2 * 60)):
            words[rng.randrange(300)] = f"n{rng.random()}"
        docs.append((k, " ".join(words)))
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_classes(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    seq = [word_hashes([t])[0] for _, t in docs]
    sets = [set(order_minhash.kmers(w, np.asarray([len(w)]))[0].tolist()) for w in seq]
    label = list(range(1_000))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    pairs = [(a, b) for a in range(1_000) for b in range(a) if (n := len(sets[a] & sets[b])) >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    assert sum(got[a] == got[b] for a, b in pairs) == len(pairs)
    for a, b in pairs:
        label[max(find(a), find(b))] = min(find(a), find(b))
    assert all(find(i) <= got[i] or got[i] == i for i in range(1_000)) and len(set(got.values())) == len({find(i) for i in range(1_000)})


def test_classes_equal_brute_force(spark):
    rng = random.Random(9)
    docs = [(r["doc_id"], r["text"] or "") for r in documents(spark).collect()]
    base = [t for _, t in docs if 300 < len(t.split()) < 900][:6]
    for k in range(60):  # copies at many similarities, some of them copies of copies
        words = (base[k % 6] if k < 40 else docs[-rng.randint(1, 30)][1]).split()
        for _ in range(rng.randint(0, max(1, len(words) // 20))):
            words[rng.randrange(len(words))] = f"new{rng.random()}"
        docs.append((1_000_000 + k, " ".join(words)))
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_classes(spark, rows).collect()}
    seq = {i: word_hashes([t])[0] for i, t in docs}
    parent = {i: i for i in seq}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = {i: set(order_minhash.kmers(w, np.asarray([len(w)]))[0].tolist()) for i, w in seq.items()}
    ids = list(seq)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if (len(x & y) >= 0.8 * len(x | y)) and order_minhash.similar(seq[ids[a]], seq[ids[b]]):
                p, q = sorted((find(ids[a]), find(ids[b])))
                parent[q] = p
    assert got == {i: find(i) for i in ids}


def test_variants_of_a_template_unlike_its_lead_equal_brute_force(spark):
    rng = random.Random(4)
    template = [f"t{i}" for i in range(400)]
    centres = [[rng.random() < 0.5 for _ in range(40)] for _ in range(40)]
    docs = []
    for k in range(200):  # every bucket is large, and few texts are like any given one
        sites = list(centres[k % 40])
        for i in rng.sample(range(40), 5):
            sites[i] = not sites[i]
        docs.append((k, " ".join(f"other{i}" if i % 10 == 5 and sites[i // 10] else w for i, w in enumerate(template))))
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_classes(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    seq = [word_hashes([t])[0] for _, t in docs]
    sets = [set(order_minhash.kmers(w, np.asarray([len(w)]))[0].tolist()) for w in seq]
    label = list(range(200))
    for a in range(200):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if label[a] != label[b] and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) and order_minhash.similar(seq[a], seq[b]):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    assert len(set(label)) > 10 and got == dict(enumerate(label))
