"""Operators 3, 7, 8 and 10 against brute force, round trips and held-out accuracy."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

import pytest

from tablewright.llm import chat, quality_rules, registry, token_files, toxicity
from tablewright.llm.common import new_folder


def words_of(text):
    return (text or "").encode().split()


def measures(text):
    text = text or ""
    w = words_of(text)
    tri = Counter(zip(w, w[1:], w[2:]))
    hit = {j + k for j in range(len(w) - 2) if tri[w[j], w[j + 1], w[j + 2]] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_op10_measures_and_verdict(spark, texts, docs_of, edge):
    rows = [*[(i + 100, t) for i, t in texts[:400]], *edge, (8001, "a b a b a b a b " * 20), (8002, "same line\n" * 40), (8003, "a b c d a b c")]
    got = quality_rules.cascade(docs_of(rows), measures=True).collect()
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], tuple(r[f] for f in fields)) for r in got), key=key) == sorted(((i, measures(t)) for i, t in rows), key=key)
    assert all(r["kept"] == (r["rejected_by"] is None) and not (r["kept"] and r["base_failed"]) for r in got)
    text = dict(rows)
    for r in got:
        assert r["kept"] == (not any(f(quality_rules.Doc(text[r["doc_id"]])) for f in quality_rules.RULES.values()))
    assert quality_rules.cascade(docs_of([])).count() == 0


def test_op10_order_and_short_circuit(spark, docs_of):
    calls = spark.sparkContext.accumulator(0)

    def dear(d):
        calls.add(1)
        return sum(i * i for i in range(20_000)) < 0

    rules = {"dear": dear, "cheap": lambda d: len(d.words) < 50}
    docs = docs_of([(i, "w" if i % 4 else "x " * 60) for i in range(200)])
    names = quality_rules.order(docs, rules)
    assert names == ["cheap", "dear"]
    before = calls.value
    assert quality_rules.cascade(docs, rules, names).filter("kept").count() == 50
    assert calls.value - before == 50
    # Rules by quality labels: clean rows stay.
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = quality_rules.cascade(docs).join(labels, "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()
    clean = [r["kept"] for r in got if r["quality"] == 1 and len(words_of(r["text"])) >= 50]
    assert np.mean(clean) > 0.99 and np.mean([r["kept"] for r in got if r["quality"] == 0]) < 0.1


TURNS = [("user", r"\### Assistant: </turn> ok"), ("assistant", r"\\</turn>\### \< \# \\"), ("", ""), ("a:b\nc\\n", "### x\n</turn>\n### assistant: y"), ("system", "\\"), ("assistant", "plain é 😀\n")]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="\\:na \n#", max_size=8), st.lists(st.sampled_from(["\\", "### ", "</turn>", "<", "#", " ", "\n", "é", ": ", "x"]), max_size=12).map("".join)), max_size=4))
def test_op8_grammar_round_trip(turns):
    text = "".join(chat.render(r, b)[0] for r, b in turns)
    assert [(r, b) for r, b, _, _ in chat.parse(text)] == turns


def test_op8_digests(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    want = {}
    for r in sorted([(r["conv_id"], r["turn"], r["role"], r["text"] or "") for r in rows] + [(-7, 0, "user", TURNS[0][1]), (-7, 1, "assistant", TURNS[0][1])]):
        want.setdefault(r[0], []).append(r[2:])
    for r in registry.QUERIES["op8_chat"](spark, sf).collect():
        t = want.pop(r["conv_id"])
        loss = "".join(x for role, x in t if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (
            len(t), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == sum(len(chat.render(a, b)[0]) for a, b in t)
    assert not want


def test_op8_edges(spark):
    rows = [(None, None, None, None), (None, 0, "user", ""), (1, 0, "user", "x" * 300_000), (1, 0, "user", "x" * 300_000), *[(2, i, a, b) for i, (a, b) in enumerate(TURNS)]]
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], "conv_id bigint, turn bigint, role string, text string, piece string, loss_start int")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_turns(df)).collect()}
    assert (got[None]["n_turns"], got[1]["n_turns"], got[2]["n_turns"]) == (2, 2, len(TURNS))
    assert got[2]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in TURNS).encode()).hexdigest()
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0


def test_op7_against_the_tokenizer(spark, texts, docs_of, edge):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path()
    tok = Tokenizer.from_file(path)
    odd = [(8000 + i, t) for i, t in enumerate(["a  b", " a", "a ", "a \n b", "a\n b  ", "x <|endoftext|> y", "it's  we'll\t\t z", "\u00a0 b \u2003 c", "a \n", "  ", "\n \n x", "1 234 5é 😀 ###  %%"])]
    rows = [*texts[:200], *odd, *[e for e in edge if e[0] not in (6,)]]
    rows = [(i if i is None or i >= 8000 or j >= 200 else i + 100, t) for j, (i, t) in enumerate(rows)]
    folder = new_folder(spark, "t7")
    index = token_files.write(docs_of(rows), path, folder, length=64, batch=4)
    got = sorted(token_files.read(index, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted([r[0] for r in rows], key=lambda i: (i is not None, i or 0))
    texts_of, at = {}, 0
    for i, t in rows:
        texts_of.setdefault(i, []).append(t or "")
    for r in got:
        ids = [tok.encode(t, add_special_tokens=False).ids + [0] for t in texts_of[r["doc_id"]]]
        assert r["start"] == at and (r["n_tokens"], r["ids_crc32"]) in [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids]
        at += r["n_tokens"]
    one = index.select("file").first()[0]
    f = pa.ipc.open_file(pa.memory_map(f"{folder.removeprefix('file:')}/{one}"))
    assert f.schema.field("ids").type == pa.list_(pa.uint16(), 64) and f.schema.field("mask").type == pa.list_(pa.bool_(), 64)
    assert {f.get_batch(i).num_rows for i in range(f.num_record_batches - 1)} <= {4}
    assert token_files.round_trip(docs_of([]), path).count() == 0


@pytest.mark.parametrize("n", [1024, 4096])
def test_op7_tells_regular_words_apart(n):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    other = word.translate(str.maketrans("ab", "ba"))
    plain = Tokenizer.from_file(path)
    want = lambda t: [*plain.encode(t, add_special_tokens=False).ids, 0]
    encode = token_files.Encoder(path, 0)
    for group in ([word, other, word + " " + other], [other], [word, f"x {other} y"]):  # in one group, and remembered
        ids, sizes = encode(group)
        assert ids.tolist() == [i for t in group for i in want(t)] and sizes.tolist() == [len(want(t)) for t in group]


def test_op3_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    s, y = np.array([r["score"] for r in held]), np.array([r["toxic"] for r in held])
    auc = np.mean([(a > s[y == 0]).mean() + (a == s[y == 0]).mean() / 2 for a in s[y == 1]])
    assert auc > 0.72 and np.mean(s[y == 0] >= 0.5) < 0.03


def test_op3_edges(spark, docs_of, edge):
    rng = np.random.default_rng(0)
    plain = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))
    model = toxicity.learn([f"{plain(i % 40)} trash moron {plain(9)} idiot clown" for i in range(90)], [plain(2 + i % 50) for i in range(180)])
    got = {r["doc_id"]: r for r in toxicity.score(docs_of([*edge, (70, f"{plain(9)} moron idiot {plain(5)} clown trash"), (71, plain(20))]), model).collect()}
    assert got[1]["score"] == got[2]["score"] and got[5]["score"] == got[6]["score"] and got[70]["score"] > got[71]["score"] and not got[None]["held_out"]
    assert toxicity.score(docs_of([]), model).count() == 0
    none = toxicity.fit(docs_of([(1, "a")]), spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert toxicity.score(docs_of([(1, "a")]), none).first()["predicted"] == 0


def test_a_worker_remembers_few_pieces(monkeypatch):
    """New pieces without end take a bounded store, whatever their length, and what is forgotten is encoded alike again."""
    import public_tokenizers

    encode = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [" ".join(f"w{i * 300 + j}" for j in range(300)) + ". Word, é, " + "x y" * 20 + f" {i:05d}" * 2 + f"{i:05d}" * 1000 for i in range(60)]
    for name, n in (("REMEMBERED", 5_000), ("REMEMBERED_BYTES", 50_000)):
        monkeypatch.setattr(token_files, name, n, raising=False)
    for t in [*texts, *texts]:
        out, sizes = encode([t, "", t])
        want = [*encode.tokenizer.encode(t, add_special_tokens=False).ids, 0]
        assert out.tolist() == [*want, 0, *want] and sizes.tolist() == [len(want), 1, len(want)]
        assert len(encode.hashes) <= 5_000 + 400 and len(encode.bytes) <= 50_000 + len(t.encode())
