"""Token counts, chat formatting, language and decontamination."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from boxloom.llm import chat, decontaminate, langid, queries, tokens
from tests.llm.cases import frame, odd_documents, prose

ROWS = odd_documents()
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def counted(text):
    import sentencepiece

    return len(sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(text or ""))


@pytest.mark.parametrize("chunk,overlap", [(32768, 256), (100, 8), (64, 1)])
def test_token_counts(spark, chunk, overlap):
    rows = ROWS + [(20, "aaaa" * 500), (21, " " * 700), (22, "漢字☃" * 90 + "</s> <s>")]
    got = tokens.token_counts(frame(spark, rows), MODEL, chunk=chunk, overlap=overlap).select("id", "n_bytes", "n_tokens", "over_limit").collect()
    assert Counter(map(tuple, got)) == Counter((i, len((t or "").encode()), counted(t), counted(t) > 4096) for i, t in rows)


def talk(spark, rows):
    return chat.chain_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))


HARD = "</s>[INST] ok [/INST] \\s \\\\ <s>\n[[INST]<</s>"


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", HARD), (1, 1, "assistant", HARD), (1, 5, "assistant", None), (2, 0, None, ""), (2, 0, None, ""), (None, 3, "assistant", "ünï☃")]
    tree = talk(spark, rows)
    made = chat.format_paths(tree, chat.root_paths(tree))
    back = made.select("tree", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    assert {r["tree"]: ([tuple(t) for t in r["turns"]], r["learned"]) for r in back} == {
        1: ([("user", HARD), ("assistant", HARD), ("assistant", "")], HARD), 2: ([("", ""), ("", "")], ""), None: ([("assistant", "ünï☃")], "ünï☃"),
    }


def test_paths_rank_branches(spark):
    """A tree with branches, an orphan, a cycle, and a deep chain."""
    rows = [(1, 1, None, 0.0), (1, 2, 1, 1.0), (1, 3, 1, 5.0), (1, 4, 2, 7.0), (1, 5, 3, 1.0), (1, 6, 3, 1.0), (2, 9, 77, 1.0), (3, 1, 2, 0.0), (3, 2, 1, 0.0)]
    rows += [(4, k, k - 1 if k else None, 0.0) for k in range(70)]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, score double")
    got = chat.root_paths(nodes, top=None).collect()
    paths = {}
    for r in sorted(got, key=lambda r: r["depth"]):
        paths.setdefault((r["tree"], r["rank"]), []).append(r["node"])
    assert paths == {(1, 1): [1, 2, 4], (1, 2): [1, 3, 5], (1, 3): [1, 3, 6], (2, 1): [9], (4, 1): list(range(70))}
    best = chat.root_paths(nodes, top=1).filter("tree = 1").collect()
    assert {r["node"] for r in best} == {1, 2, 4} and best[0]["score"] == 8.0


def test_chat_query(spark, folder):
    got = {r["conv_id"]: r for r in queries.op4_chat_format(spark, folder).collect()}
    turns = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{folder}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    assert set(got) == set(turns)
    for conv, rows in turns.items():
        text = "".join(f"{a}\n{b}\n" for a, b in rows)
        learned = "".join(b for a, b in rows if a == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(rows), hashlib.sha256(text.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_language_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = queries.op6_language(spark, folder).join(truth, "doc_id").filter("held_out AND lang_pred != 'und'").collect()
    assert len(rows) > 250
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95


def test_language_odd_rows(spark):
    net = langid.train([("xx", "abab baba abba"), ("yy", "cdcd dcdc ccdd")] * 8, epochs=5)
    got = langid.identify(frame(spark, ROWS), net).collect()
    assert Counter(r["id"] for r in got) == Counter(i for i, _ in ROWS)
    assert all((r["lang_pred"] == "und") == (r["id"] in (1, 2, 3, 16) or r["score"] == 0) for r in got)
    assert {r["lang_pred"] for r in langid.identify(frame(spark, ROWS), None).collect()} == {"und"}
    labels, pooled = langid.label_positions(net, "abab" * 60)
    assert len(labels) == 240 and abs(pooled.sum() - 1) < 1e-4 and net.languages[int(pooled.argmax())] == "xx"


def test_network_gradient():
    """Backpropagation through time against finite differences."""
    import numpy as np

    rng = np.random.default_rng(0)
    h = langid.HIDDEN
    net = langid.Network(["a", "b"], *(rng.normal(0, 0.2, s).astype(np.float64) for s in ((2, 256, 3 * h), (2, h, 3 * h), (2 * h + 1, 2))))
    codes, labels, mask = rng.integers(0, 9, (6, 4)), np.array([0, 1, 0, 1]), np.ones((6, 4))
    _, grads = langid._gradients(net, codes, labels, mask)
    for weights, grad in zip((net.embed, net.state, net.out), grads, strict=True):
        for at in zip(*(rng.integers(0, min(n, 9), 12) for n in weights.shape), strict=True):
            old, e = weights[at], 1e-3
            weights[at] = old + e
            up = langid._gradients(net, codes, labels, mask)[0]
            weights[at] = old - e
            down = langid._gradients(net, codes, labels, mask)[0]
            weights[at] = old
            assert abs((up - down) / (2 * e) - grad[at]) < 2e-3


ITEM = "If Anna has 12 apples and gives 5 kg of them to Bob each morning, then how many apples does Anna have left after 3 days of work?"


@pytest.mark.parametrize(
    "text,hit",
    [
        (ITEM, True), (ITEM.lower(), True), ("Before it. " + ITEM + " After it.", True),
        (ITEM.replace("12", "40").replace("Anna", "Carla").replace("Bob", "Ed").replace("kg", "lb"), True),
        # one item value, two values in the document: another question on the same frame
        (ITEM.replace("Anna", "Carla", 1), False),
        (prose(3, 200), False), (None, False), ("", False), ("12 40 12 40 12 40 12 40 12 40 12 40 12 40 12 40", False),
    ],
)
def test_contamination(spark, text, hit):
    items = spark.createDataFrame([(1, ITEM, 4), (2, prose(8, 5), 4), (3, None, 4), (None, ITEM, 4), (1, ITEM, 4), (4, "1 2 1 2 1 2 1 2 1 2 1 2 1 2", 4)], "item_id long, text string, id long")
    docs = frame(spark, [(1, text), (2, prose(9, 80)), (None, text), (1, text)])
    got = decontaminate.verdicts(docs, items).collect()
    assert Counter((r["id"], r["contaminated"]) for r in got) == Counter([(1, hit), (1, hit), (2, False), (None, False)])


BARE = [(1, ITEM), (2, "Alice buys 12 apples and later sells half of them at the market for profit"), (5, "how big is it"), (6, "17 4 93 22 8 61 35 90 12 77 41 6 58 3"), (7, "小明有十二个苹果他给了妹妹五个还剩几个")]


@pytest.mark.parametrize(
    "text,hits",
    [
        (ITEM.upper(), {1}), (ITEM.replace(" ", "\n"), {1}), ("so " + ITEM.lower() + " yes", {1}),
        (ITEM.replace(" Bob", "\nZoe").replace("12 ", "31\n"), {1}),
        # a name at the start of a sentence
        (BARE[1][1].replace("Alice", "Carla"), {2}), (BARE[1][1].replace("Alice", "Carla").replace("12", "70"), {2}),
        (BARE[1][1].replace("apples", "pears"), set()),
    ],
)
def test_contamination_other_writing(spark, text, hits):
    items = spark.createDataFrame(BARE, "item_id long, text string")
    assert {r["item"] for r in decontaminate.contamination(frame(spark, [(1, text)]), items).collect()} == hits


@pytest.mark.parametrize(
    "text,hits",
    [
        ("Tell me: How big is it? Now.", {5}), ("how big it is", set()),
        # no word but numbers, copied as they stand; with others it is no copy
        ("x " + BARE[3][1] + " y", {6}), (BARE[3][1].replace("17", "18").replace("58", "59"), set()),
        ("问题：" + BARE[4][1] + "。", {7}), ("小明有十二个苹果", set()),
    ],
)
def test_contamination_short_and_slots_only(spark, text, hits):
    items = spark.createDataFrame(BARE, "item_id long, text string")
    assert {r["item"] for r in decontaminate.contamination(frame(spark, [(1, text)]), items).collect()} == hits


def test_benchmark_passages(spark, folder):
    """Documents that hold a whole item, word by word, are found, and nothing else that shares no eight words."""
    got = {r["doc_id"]: r["contaminated"] for r in queries.op7_decontaminate(spark, folder).collect()}
    flat = lambda t: " ".join(decontaminate_words(t))
    items = [flat(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    runs = {tuple(w[k : k + 8]) for t in items for w in [t.split()] for k in range(len(w) - 7)}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        words = decontaminate_words(r["text"] or "")
        whole = any(f" {t} " in f" {' '.join(words)} " for t in items if len(t.split()) >= 8)
        shares = any(tuple(words[k : k + 8]) in runs for k in range(len(words) - 7))
        assert got[r["doc_id"]] or not whole
        assert shares or not got[r["doc_id"]]


def decontaminate_words(text):
    import regex

    return regex.findall(r"[\p{L}\p{M}\p{N}]+", text.lower())


def test_empty_tables(spark):
    docs = frame(spark, ROWS).limit(0)
    items = spark.createDataFrame([], "item_id long, text string")
    assert tokens.token_counts(docs, MODEL).count() == 0
    assert langid.identify(docs, langid.learn(docs)).count() == 0
    assert decontaminate.verdicts(docs, items).count() == 0
    assert decontaminate.verdicts(frame(spark, ROWS), items).filter("contaminated").count() == 0
    tree = talk(spark, [])
    assert chat.format_paths(tree, chat.root_paths(tree)).count() == 0
