import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import encode, leaks, lookalike

CLASH = "doc_id long, text string, look string, pos int, word string, ids string, words int"


def docs(spark, texts, extra=("x", 1, "w", "i", 2)):
    return spark.createDataFrame([(i, t, *extra) for i, t in enumerate(texts)], CLASH)


@pytest.mark.parametrize(
    "a, b",
    [("Ａ１，", "A1,"), ("e\u0301", "é"), ("a\u200bb\u2060\ufeff\u00ad", "ab"), ("x\u00a0y\u2009z\u3000", "x y z "), ("ﬁﬂ", "fifl"), ("раypаl", "paypal"), ("ΑΒΕ", "ABE"), ("ѕеё", "seë"), ("ｶﾞ", "ガ"), ("e\u200b\u0301", "é"), ("\u1112\u1161\u11ab", "한"), ("i\u0456", "ii"), ("\u0133\u2177", "ijviii"), ("\u01c6", "dž")],
)
def test_same_look(a, b):
    assert lookalike.canonical(a) == lookalike.canonical(b) == unicodedata.normalize("NFC", b)


@pytest.mark.parametrize("a, b", [("A", "a"), ("é", "e"), ("1", "l"), ("a  b", "a b"), ("²", "2"), ("½", "1/2"), ("№", "No"), ("a.", "a"), ("👩\u200d💻", "👩💻"), ("…", "..."), ("ß", "β")])
def test_other_look(a, b):
    assert lookalike.canonical(a) != lookalike.canonical(b)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=40))
def test_canonical_is_whole_normalisation(text):
    """Splicing normalised segments equals normalising everything, and doing it twice changes nothing."""
    once = lookalike.canonical(text)
    assert lookalike.canonical(once) == once
    change, _ = lookalike._tables()
    kept = lookalike._PICTURES.sub("\\1\ue000", text)
    whole = unicodedata.normalize("NFC", unicodedata.normalize("NFD", kept).translate({**change, **{ord(k): v for k, v in lookalike.LOOKALIKES.items()}})).replace("\ue000", "\u200d")
    if unicodedata.normalize("NFC", text) == text:
        assert lookalike.canonical(whole) == once


def test_look_pairs(spark):
    texts = ["paypal", "раураl", "paypal", "PayPal", None, "", "\u200b", "none " * 20_000, "nоne " * 20_000]
    got = {tuple(r) for r in lookalike.look_pairs(docs(spark, texts)).collect()}
    assert got == {(0, 1), (1, 2), (5, 6), (7, 8)}
    assert {r.doc_id: r.class_id for r in lookalike.look_report(docs(spark, texts)).collect()} == {0: 0, 1: 0, 2: 0, 5: 5, 6: 5, 7: 7, 8: 7}
    forms = {r.doc_id: (r.text, r.changed) for r in lookalike.canonical_documents(docs(spark, texts)).collect()}
    assert forms[1] == ("paypal", True) and forms[3] == ("PayPal", False) and forms[4] == (None, None)
    assert lookalike.look_pairs(docs(spark, texts).limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefg"), max_size=6), max_size=5), st.sets(st.sampled_from("abcdefg")))
def test_segments_and_rare_words_in_order(docs_, hot):
    import pyarrow as pa

    ids = {w: [ord(w), 1][: 1 + i % 2] for i, w in enumerate(sorted(hot))}
    kind = pa.list_(pa.int32())
    got = encode.segmented(pa.array(docs_, pa.list_(pa.string())), pa.array(list(ids), pa.string()), pa.array(list(ids.values()), kind))
    for words, segments, rare in zip(docs_, got[0].to_pylist(), got[1].to_pylist()):
        assert rare == [w for w in words if w not in hot] and len(segments) == len(rare) + 1
        want = [[]]
        for w in words:
            if w in hot:
                want[-1] += ids[w]
            else:
                want.append([])
        assert segments == want


def test_encoding_round_trip_and_ids(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import os

    texts = ["", None, "Hello  world\n\n\tdon't <|endoftext|> 123", "é 中文 👩\u200d💻 \u00a0x", "a" * 5000, " " * 300 + "x", "same", "same", "x" * 70 + " " + "y" * 70]
    got = {r.doc_id: r.ids for r in encode.encode_corpus(docs(spark, texts)).collect()}
    t = tokenizers.Tokenizer.from_file(os.path.join(encode.TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    limit, encode.HOT_WORDS = encode.HOT_WORDS, 8  # most words are rare
    assert got == {r.doc_id: r.ids for r in encode.encode_corpus(docs(spark, texts)).collect()}
    encode.HOT_WORDS = limit
    back = {r.doc_id: r.text for r in encode.decode_corpus(encode.encode_corpus(docs(spark, texts))).collect()}
    assert back == {i: x or "" for i, x in enumerate(texts)}
    assert encode.encode_corpus(docs(spark, texts).limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=12), st.lists(st.integers(0, 3), min_size=1, max_size=20))
def test_myers_is_edit_distance_to_a_substring(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    assert leaks.myers(np.array([p]), np.array([t]))[0] == min(row)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32))
def test_every_leak_within_the_budget_is_hit(seed):
    """Pieces, windows and distances find what comparing every window of the item with the whole document finds."""
    rng = np.random.default_rng(seed)
    w, budget = int(rng.integers(6, 14)), int(rng.integers(0, 3))
    q = (w + 1) // (budget + 2)
    side, pad = w - q, w - q + budget
    item = rng.integers(1, 60, int(rng.integers(w, 30)))
    doc = np.concatenate([rng.integers(1, 60, int(rng.integers(0, 9))), item[int(rng.integers(0, 6)) :], rng.integers(1, 60, 5)]).tolist()
    for _ in range(int(rng.integers(0, 4))):
        at = int(rng.integers(0, len(doc)))
        doc[at : at + int(rng.integers(0, 2))] = [int(x) for x in rng.integers(1, 60, int(rng.integers(0, 2)))]
    want = min([budget + 1, *(int(leaks.myers(item[None, i : i + w], np.array([doc]))[0]) for i in range(len(item) - w + 1))]) if doc else budget + 1
    wide_i, wide_d = np.pad(item, side), np.pad(np.array(doc), pad)
    hits = [(d, p) for p in range(0, len(item) - q + 1, q) for d in range(len(doc) - q + 1) if doc[d : d + q] == item[p : p + q].tolist()]
    got = budget + 1
    if hits:
        got = leaks.verify(np.array([wide_d[d : d + 2 * pad + q] for d, _ in hits]), np.array([wide_i[p : p + 2 * side + q] for _, p in hits]), w, q, budget).min()
    assert got == want


def test_reader_words():
    assert leaks.reader_words("Вig-ＨЕLLО\nwо\u200brld_1 café") == leaks.reader_words("big hello WORLD 1 CAFÉ")
    assert all(c < 128 and len(v) == 1 and v == chr(c).lower() for c, v in leaks._CLASSES.items() if c < 128)


def test_leaks(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    w = item.split()
    texts = [
        "x " + " ".join(w[1:13]).upper().replace(" ", ",\n") + " y", " ".join(w[:11]), None, "", "see: " + " ".join(w[2:]).replace("e", "е") + "!", " ".join(w[:6]) + " x " + " ".join(w[6:]),
        " ".join(w).replace("seven", "sevan"), "pad " * 30_000 + item, "nothing", " ".join([*w[:11], *w[:11]]),
    ]
    items = spark.createDataFrame([(1, item, "a"), (2, "too short", "b"), (3, None, "c"), (4, item + " fifteen", "d"), (5, "", "e")], "item_id long, text string, words string")
    got = {tuple(r) for r in leaks.leaked(docs(spark, texts), items).collect()}
    assert got == {(d, i) for d in (0, 4, 7) for i in (1, 4)}
    near = {(r.doc_id, r.item_id): r.distance for r in leaks.leaks(docs(spark, texts), items).collect()}
    assert near[(6, 1)] == 1 and near[(0, 1)] == 0 and near[(1, 1)] == 1 and near[(5, 1)] == 1 and (9, 1) in near and (8, 1) not in near
    # Only pieces and Myers' distance can find these; beyond the limit of the broadcast the rows are the same.
    assert {k for k, v in near.items() if v == 0} == got
    limit, leaks.BROADCAST_PIECES = leaks.BROADCAST_PIECES, 0
    assert {(r.doc_id, r.item_id): r.distance for r in leaks.leaks(docs(spark, texts), items).collect()} == near
    leaks.BROADCAST_PIECES = limit
    assert leaks.leaked(docs(spark, texts).limit(0), items).count() == 0 and leaks.leaked(docs(spark, texts), items.limit(0)).count() == 0
