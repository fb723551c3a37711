import random

import pyarrow as pa
import pytest
from newsgauge.llm import bpe, lexicon, token_counts
from pyspark.sql import functions as F

WORDS = "/opt/tokenizers/word_bpe_49k.json"
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(WORDS)


def odd_texts():
    rng = random.Random(6)
    points = [*range(1, 0x250), *range(0x300, 0x340), *range(0x370, 0x400), 0x130, 0x3A3, 0x2160, 0xB2, 0x2028,
              0x85, 0xA0, 0x1C, 0x200B, 0x212B, 0x1F600, 0xFB01, 0x1E9E, 0xAC00, 0x1100, 0x1161, *[0x27, 0x73] * 20]
    odd = ["".join(map(chr, rng.choices(points, k=40))) for _ in range(300)]
    return odd + ["it's we'LL <|endoftext|>x<|startoftext|>", "a" * 3000, "İstanbul ΣΑΣ", "", "x\x00y"]


def test_ids_and_text_equal_the_library(spark, library):
    texts = odd_texts()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for size in (5, 500):
        name = bpe.compile_lexicon(frame, WORDS, size=size)
        for r in bpe.decode(bpe.encode(frame, WORDS, name), WORDS).collect():
            want = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
            assert r["ids"] == want
            assert r["decoded"] == library.decode(want, skip_special_tokens=False)


def test_transducer_is_minimal_and_maps_every_word(tmp_path):
    rng = random.Random(7)
    entries = {bytes(rng.choices(b"ab\xc3z", k=rng.randint(1, 6))): [k, k + 1][:k % 3] for k in range(300)}
    path = tmp_path / "lexicon"
    path.write_bytes(lexicon.build(entries))
    found = lexicon.Lexicon(str(path))
    words = [*entries, b"", b"zzzzzzzz", b"q", b"ab\xff"]
    for word, place in zip(words, found.places(words).tolist()):
        if word in entries:
            assert found.ids[found.offsets[place]:found.offsets[place + 1]].tolist() == entries[word]
        else:
            assert place == -1
    # words with a common ending share its states
    shared = lexicon.build({a + b"ingly": [1] for a in (b"know", b"seem", b"will", b"lov")})
    (tmp_path / "s").write_bytes(shared)
    assert lexicon.Lexicon(str(tmp_path / "s")).final.size == 18  # 1 + 3 + 3 + 3 + 2 and the six of "ingly"
    (tmp_path / "none").write_bytes(lexicon.build({}))
    assert lexicon.Lexicon(str(tmp_path / "none")).places([b"a", b""]).tolist() == [-1, -1]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_allotment_equals_token_by_token(spark, rule):
    rng = random.Random(8)
    texts = ["one two\nthree\n\nfour é\U0001f600\nend", "", "\n\n", "no break", "a  \n  b\n\n\n c"] + odd_texts()[:20]
    rows = []
    for k, t in enumerate(texts):
        cuts = sorted(rng.choices(range(len(t) + 1), k=6))
        rows.append((k, t, [(cuts[0], cuts[1]), (cuts[1], cuts[3]), (cuts[4], cuts[5])]))
    frame = spark.createDataFrame(rows, "doc_id long, text string, parts array<struct<start:int,end:int>>")
    got = {}
    for r in token_counts.allot(frame, RANKS, rule, sections_col="parts").collect():
        got.setdefault(r["doc_id"], {})[r["section"]] = (r["n_tokens"], r["n_crossing"])
    for k, text, parts in rows:
        want = {i: [0, 0] for i in range(3)}
        for start, end in zip(*token_counts.token_spans(text, RANKS)):
            share = [min(e, end) - max(s, start) if e > s else 0 for s, e in parts]
            mark = start if rule == "start" else end - 1
            inside = [i for i, (s, e) in enumerate(parts) if s <= mark < e]
            if rule == "most":
                inside = [share.index(max(share))] if max(share) > 0 else []
            home = inside[0] if inside else None
            entry = want.setdefault(home, [0, 0])
            entry[0] += 1
            if home is not None:
                entry[1] += start < parts[home][0] or end > parts[home][1]
        assert got[k] == {i: tuple(v) for i, v in want.items()}, (text, parts)


def test_lines_add_up_to_the_whole(spark):
    import tiktoken
    encoder: tiktoken.Encoding = token_counts.encoding(RANKS)[0]
    texts = odd_texts()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = token_counts.allot(frame, RANKS).groupBy("doc_id").agg(
        F.sum("n_tokens").alias("n"), F.max("end").alias("end"), F.count("*").alias("lines")).collect()
    for r in out:
        text = texts[r["doc_id"]]
        assert (r["n"], r["end"], r["lines"]) == (
            len(encoder.encode_ordinary(text)), len(text), text.count("\n") + 1)


def test_awkward_and_empty_tables(awkward, nothing):
    for docs in (awkward, nothing):
        name = bpe.compile_lexicon(docs, WORDS)
        out = bpe.decode(bpe.encode(docs, WORDS, name), WORDS)
        assert out.columns == [*docs.columns, "ids", "decoded"] and out.count() == docs.count()
        assert out.where("text IS NULL AND (size(ids) > 0 OR decoded <> '')").count() == 0
        lines = token_counts.allot(docs, RANKS)
        assert lines.where("section = 0").count() == docs.count()


def test_few_remembered_pieces_and_small_chunks_give_the_same_ids(tmp_path):
    words, known, path = bpe.Vocabulary(WORDS), ["text", "of"], tmp_path / "few"
    path.write_bytes(lexicon.build({w.encode(): ids for w, ids in zip(known, words.merge_all(known))}))
    texts = pa.array([f"text {k} of word{k % 7}, Überfluß x{k * k}" for k in range(500)] + [None, "", "text"])
    few, many = (bpe.Encoder(words, lexicon.Lexicon(str(path)), n) for n in (40, bpe.REMEMBERED))
    found = []
    for _, part in bpe.chunks(texts, 100):
        assert len(part) <= 7
        found += few.encode(part)[1].tolist()
        assert len(few.index) <= 40 + sum(len(t.split()) for t in part)
    assert found == many.encode([t or "" for t in texts.to_pylist()])[1].tolist()
    assert len(many.index) > 500
