"""Every dealt query and pipeline stage on odd and on empty tables."""

import hashlib

import pytest

from tests.llm.conftest import LONG, ROWS
from weftline.llm.queries import QUERIES


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, empty, name):
    rows = QUERIES[name](spark, empty).collect()
    assert [r for r in rows if r[0] != -1] == []


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("op3_chat_format", "op9_top_k", "op13_conversation_trie")])
def test_one_row_or_more_for_each_document(spark, odd, name):
    got = [r["doc_id"] for r in QUERIES[name](spark, odd).collect()]
    assert set(got) == {r[0] for r in ROWS}
    if name != "op6_packing":
        assert sorted(map(str, got)) == sorted(str(r[0]) for r in ROWS)


def test_language(spark, odd):
    got = {r["doc_id"]: r for r in QUERIES["op1_language_id"](spark, odd).collect()}
    for i in (3, 4, 5):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_pii(spark, odd):
    got = {r["doc_id"]: r for r in QUERIES["op2_pii"](spark, odd).collect()}
    r = got[9]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1)
    assert got[4]["spans"] == "" and got[4]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_chat(spark, odd):
    got = {r["conv_id"]: r for r in QUERIES["op3_chat_format"](spark, odd).collect()}
    assert set(got) == {1, 2, 3, None, -1}
    turns = "user\nhi </s> & &lt; <|im_end|>\nuser\n\n" + "assistant\n[INST] yo [/INST]\n" * 2
    assert got[1]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
    assert got[1]["n_turns"] == 4 and got[1]["n_blocks"] == 2
    assert got[1]["loss_sha256"] == hashlib.sha256(b"[INST] yo [/INST]" * 2).hexdigest()
    assert got[2]["turns_sha256"] == hashlib.sha256(b"\nx\ny\n").hexdigest()
    assert got[None]["turns_sha256"] == hashlib.sha256(b"a\nb\nz\n").hexdigest()
    assert got[3]["loss_chars"] == 0 and got[3]["n_turns"] == 1


def test_fingerprints(spark, odd):
    rows = QUERIES["op4_fingerprints"](spark, odd).collect()
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["fingerprint"] == by[7]["fingerprint"] and by[1]["fingerprint"] == by[6]["fingerprint"]
    assert by[3]["fingerprint"] == by[4]["fingerprint"]
    assert by[8]["n_chars"] == len(LONG)
    # the next of 9 is 8; the next of the null id, which is last, is the greatest id
    text = {r[0]: r[1] or "" for r in ROWS}

    def edited(i, j):
        k = len(text[i]) // 2
        return hashlib.sha256((text[i][: len(text[i]) - k] + text[j][:k]).encode()).hexdigest()

    assert by[9]["edited_sha256"] == edited(9, 8)
    assert by[None]["edited_sha256"] == edited(None, 9007199254740993)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)


def test_toxicity(spark, odd):
    rows = QUERIES["op5_toxicity"](spark, odd).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_packing(spark, odd):
    rows = QUERIES["op6_packing"](spark, odd).collect()
    assert {(r["length"], r["start"], r["piece"]) for r in rows if r["doc_id"] in (3, 4)} == {(1, 0, 0)}
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_language_model(spark, odd):
    rows = {r["doc_id"]: r for r in QUERIES["op7_maxent_lm"](spark, odd).collect()}
    assert rows[3]["n_tokens"] == rows[4]["n_tokens"] == 1
    assert len({r["train_tokens"] for r in rows.values()}) == 1


def test_search(spark, odd):
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in QUERIES["op9_top_k"](spark, odd).collect()}
    assert {q for q, _ in got} == {0, 50, 100}
    best = [got[(50, k)][0] for k in range(1, 6)]
    assert 50 not in best and best == [110, 90, 80, 70, 60] or len(set(best)) == 5
    assert (50, 6) not in got


def test_near_duplicates(spark, odd):
    rows = QUERIES["op10_near_duplicates"](spark, odd).collect()
    by = {r["doc_id"]: r["class_id"] for r in rows}
    assert by[6] == by[1] == 1 and by[7] == by[2] == 2 and by[4] == by[3] == 3
    assert by[None] is None and by[8] == 8


def test_repeats(spark, odd):
    rows = QUERIES["op11_suffix_dedup"](spark, odd).collect()
    by = {r["doc_id"]: r for r in rows}
    assert by[4]["n_bytes"] == 0 and by[4]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    # the sentence of the long text stays once, and so does the single letter's run
    assert by[8]["n_bytes"] == len(LONG) and by[8]["n_removed"] == len(LONG) - len(LONG) // 9_000
    assert by[9007199254740993]["n_removed"] == 5_000 - 1 and by[9007199254740993]["n_spans"] == 1
    assert len([r for r in rows if r["doc_id"] == 6]) == 2


def test_fill_middle(spark, odd):
    rows = QUERIES["op12_fill_middle"](spark, odd).collect()
    text = {r[0]: r[1] or "" for r in ROWS}
    for r in rows:
        assert r["restored_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()
        assert (r["prefix_chars"] is None) == (r["form"] == "plain")


def test_trie(spark, odd):
    rows = QUERIES["op13_conversation_trie"](spark, odd).collect()
    root = next(r for r in rows if r["depth"] == 0)
    assert (root["n_convs"], root["conv_id"], root["parent_conv_id"]) == (4, None, None)
    assert root["n_leaves"] == sum(r["n_children"] == 0 for r in rows)


def test_stages(spark, odd, empty, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    for table in (odd, empty):
        docs = spark.read.parquet(f"{table}/documents.parquet")
        columns = docs.columns
        for i, (name, stage) in enumerate(pipeline.STAGES):
            out = f"{tmp_path}/{table.rsplit('/', 1)[1]}-{i}"
            stage(spark, docs, table).write.parquet(out)
            docs = spark.read.parquet(out)
            if i < len(pipeline.STAGES) - 1:
                assert docs.columns == columns, name
                if table == odd and name != "language":
                    assert {r["score"] for r in docs.select("score").collect()} <= {"clash"}


def test_one_of_each_group_stays(spark, odd):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    kept = [r["doc_id"] for r in pipeline.keep_one_of_each(spark, docs, odd).collect()]
    assert sorted(kept, key=str) == sorted([1, 2, 3, 5, 8, 9, 9007199254740993, None], key=str)


def test_the_pipeline_equals_its_stages_by_brute_force(spark):
    """Kept documents, redactions and packing of ``run``, recomputed by plain loops from the learned models."""
    pipeline = pytest.importorskip("corpus_pipeline")
    from tests.conftest import SF
    from tests.llm.test_methods import base_spans
    from weftline.llm import language_id, order_minhash, toxicity
    from weftline.llm.wordhash import word_hashes

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    filters = language_id.fit_on_documents(docs)
    lang, score = language_id.decide(filters, list(rows.values()))
    rows = {i: t for (i, t), a, s in zip(rows.items(), lang, score) if a != "und" and s >= pipeline.LEAST_LANGUAGE}
    known = docs.where(docs["doc_id"].isin(list(rows)))
    lexicon = toxicity.fit_on_documents(known, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = toxicity.score(lexicon.curve, toxicity.features(lexicon.automaton(), list(rows.values())))
    rows = {i: t for (i, t), s in zip(rows.items(), toxic) if s < 0.5}
    seq = {i: word_hashes([t or ""])[0] for i, t in rows.items()}
    kept = {}
    label = {i: i for i in rows}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(rows)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if order_minhash.similar(seq[a], seq[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    kept = [i for i in ids if find(i) == i]
    packed = pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in packed} == set(kept)
    assert len({(r["doc_id"], r["piece"]) for r in packed}) == len(packed)
    used = {}
    for r in packed:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    redacted = {r["doc_id"]: r["text"] for r in pipeline.redact_personal_data(spark, docs.where(docs["doc_id"].isin(kept)), SF).collect()}
    assert all(not base_spans(t or "") for t in redacted.values())
    assert sum(redacted[i] != rows[i] for i in kept) >= sum(bool(base_spans(rows[i] or "")) for i in kept) > 0


def test_without_languages_documents_with_letters_stay(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([(1, "abc", None), (2, "12", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in pipeline.keep_known_language(spark, docs, "").collect()] == [1]
