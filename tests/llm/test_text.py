import os
import random

import pytest
from pyspark.sql import functions as F

from seqsys.llm.leaks import leaks, leaks_in_index, positional_index
from seqsys.llm.subjects import SubjectRules, boilerplate_keys, cut, cut_pages, subjects
from seqsys.llm.text import readable, words
from seqsys.llm.tokens import TokenAutomaton, decode_corpus, encode_corpus, read_vocabulary
from seqsys.session import Scratch

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")

TEXTS = ["", None, "hello world", "aaaaaaaaaaaaaaaa", "a" * 5001, " " * 700 + "x", "<|endoftext|> is text", "It's the naïve façade – 日本語テキスト 🚀🧪👨‍🍳",
    "\n\n \t tabs\r\n", "1234567890 3.14159", "Überraschung größer Ж" * 3, "ababababababab" * 20]


def test_merges_with_overlaps():
    # bytes a, b; merges aa, ab, aab, so that leftmost and rank both matter
    tokens = [b"a", b"b", b"aa", b"ab", b"aaab"]
    merges = [(0, 0, 2), (0, 1, 3), (2, 3, 4)]
    automaton = TokenAutomaton(tokens, merges, {})

    def slow(word):
        ids = [tokens.index(bytes([c])) for c in word]
        for u, v, w in merges:
            i, out = 0, []
            while i < len(ids):
                if ids[i : i + 2] == [u, v]:
                    out.append(w)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    rng = random.Random(1)
    for _ in range(500):
        word = bytes(rng.choice(b"aab") for _ in range(rng.randrange(1, 14)))
        assert automaton.encode(word) == slow(word), word
        assert automaton.decode(automaton.encode(word)) == word


@needs_vocabulary
def test_encoding_equals_the_library_and_round_trips(spark):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(VOCABULARY)
    reference.encode_special_tokens = True
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc long, text string, ids string")
    encoded = encode_corpus(df, "doc", "text", VOCABULARY)
    got = {r.doc: r.ids for r in encoded.collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == (reference.encode(t, add_special_tokens=False).ids if t else [])
    back = {r.doc: r.text for r in decode_corpus(encoded, "doc", "ids", VOCABULARY).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))
    assert encode_corpus(df.limit(0), "doc", "text", VOCABULARY).count() == 0


@needs_vocabulary
def test_automaton_on_random_bytes():
    automaton = TokenAutomaton(*read_vocabulary(VOCABULARY))
    rng = random.Random(7)
    for _ in range(300):
        word = bytes(rng.randrange(256) for _ in range(rng.randrange(1, 40)))
        assert automaton.decode(automaton.encode(word)) == word


@pytest.mark.parametrize("charset", ["cp1251", "koi8-r", "utf-8"])
def test_garbled_russian_is_read(charset):
    text = "Каждый нападающий требует внимания, считает Ixorika. Сначала появился вратарь, затем медаль."
    raw = f'<html lang="ru"><head><meta charset="x-unknown"></head><p>{text}</p></html>'.encode(charset)
    for wrong in ("utf-8", "latin-1", "cp1251", "koi8-r"):
        seen = raw.decode(wrong, "replace")
        assert words(text) == words(readable(seen, raw)) or wrong == charset, (charset, wrong)


def test_words():
    assert words("昨年、港は22,55回、旅程とともに報告された。") == ["昨年", "港", "は", "22", "55", "回", "旅程", "とともに", "報告", "された"]
    assert words("The ques-\ntion &amp; ﬁne Größe, 12,5\xad") == ["the", "question", "fine", "große".casefold().replace("ö", "o"), "12", "5"]
    assert readable(None, b"x") == "" and readable("", None) == ""


NOUNS = ["telescope", "isotope", "enzyme", "glacier", "neutron", "orbit", "fossil", "laser", "plasma", "genome"]


def sentence(rng, tag):
    return f"The {rng.choice(NOUNS)} near {tag}{rng.randrange(10**6)} measured {rng.randrange(9999)} {rng.choice(NOUNS)}s while {tag}{rng.randrange(10**6)} tested the {rng.choice(NOUNS)} again."


def test_leaks(spark):
    rng = random.Random(11)
    passages = {i: [sentence(rng, f"Item{i}x") for _ in range(5)] for i in range(30)}
    items = [(i, " ".join(s), f"Read the passage and answer. {sentence(rng, f'Q{i}x')} {sentence(rng, f'Q{i}y')}", "answer") for i,
        s in passages.items()] + [(99, None, None, "x"), (None, "a b c", "d", "y")]
    filler = lambda n, tag: " ".join(sentence(rng, tag) for _ in range(n))
    docs = [(i, filler(12, f"Doc{i}x")) for i in range(300)]
    found = set()

    def add(doc, item, body):
        docs.append((doc, body))
        if item is not None:
            found.add((doc, item))

    add(1000, 3, filler(5, "A") + " " + " ".join(passages[3]) + " " + filler(5, "B"))  # whole
    add(1001, 4, " ".join(passages[4][1:3]).upper().replace(".", " ") + filler(5, "C"))  # a run, other case
    changed = " ".join(passages[5]).split()
    changed[10], changed[33] = "swapped", "words"
    add(1002, 5, filler(4, "D") + " " + " ".join(changed))  # altered
    add(1003, 6, " ".join(f"{s} {filler(2, 'E')}" for s in reversed(passages[6])))  # scattered
    add(1004, None, filler(4, "F") + " " + " ".join(passages[7][0].split()[:9]) + " " + filler(4, "G"))  # a few words only
    add(1005, None, "Read the passage and answer. " + filler(6, "H"))  # the instruction alone
    add(1006, 8, filler(3, "I") + " " + items[8][2])  # a question
    add(1007, 3, filler(5, "A") + " " + " ".join(passages[3]) + " " + filler(3000, "J"))  # a very long page
    add(1008, None, None)
    add(1009, None, "")
    add(1010, None, "  \n ")
    d = spark.createDataFrame([(*x, None, 1) for x in docs], "id long, text string, raw binary, page int")
    t = spark.createDataFrame(items, "item long, passage string, question string, answer string")
    kw = dict(doc="id", text="text", raw="raw", item="item", passage="passage", question="question")
    got = [tuple(r) for r in leaks(d, t, **kw).collect()]
    assert set(got) == found and len(got) == len(found)
    assert leaks(d.limit(0), t, **kw).count() == 0 and leaks(d, t.limit(0), **kw).count() == 0


LEAK_COLUMNS = dict(doc="id", text="text", raw="raw", item="item", passage="passage", question="question")


def leak_tables(spark, docs, passages):
    d = spark.createDataFrame([(*x, None) for x in docs], "id long, text string, raw binary")
    return d, spark.createDataFrame([(i, " ".join(s), None) for i, s in passages.items()], "item long, passage string, question string")


def test_leaks_of_an_item_on_very_many_pages(spark):
    rng = random.Random(21)
    passages = {i: [sentence(rng, f"Item{i}x") for _ in range(5)] for i in range(30)}
    docs = [(i, " ".join(sentence(rng, f"Doc{i}x") for _ in range(12))) for i in range(300)]
    found = set()
    for i in range(0, 300, 3):  # a third of the pages mirrors one item
        docs[i] = (i, docs[i][1] + " " + " ".join(passages[3]))
        found.add((i, 3))
    d, t = leak_tables(spark, docs, passages)
    assert {tuple(r) for r in leaks(d, t, **LEAK_COLUMNS).collect()} == found

    few = [(i, t) for i, t in docs if i not in dict(list(docs)[::3])] + [(900 + i, docs[i][1]) for i in range(0, 60, 3)]  # on 20 pages of 220
    d, t = leak_tables(spark, few, passages)
    assert {tuple(r) for r in leaks(d, t, **LEAK_COLUMNS).collect()} == {(900 + i, 3) for i in range(0, 60, 3)}


@pytest.mark.parametrize("sharing", [3, 10, 100])
def test_leaks_of_a_passage_of_many_items(spark, sharing):
    rng = random.Random(24)
    passages = {i: [sentence(rng, f"Item{i}x") for _ in range(5)] for i in range(30)}
    shared = [sentence(rng, "Shared") for _ in range(5)]
    passages |= {100 + i: shared + ([f"Its ending {i} is another."] if i % 2 else []) for i in range(sharing)}
    docs = [(i, " ".join(sentence(rng, f"Doc{i}x") for _ in range(12))) for i in range(200)] + [(1000, f"{sentence(rng, 'A')} {' '.join(shared)} {sentence(rng, 'B')}")]
    d, t = leak_tables(spark, docs, passages)
    assert {tuple(r) for r in leaks(d, t, **LEAK_COLUMNS).collect()} == {(1000, 100 + i) for i in range(sharing)}


def test_segments_and_index_of_other_tests(spark, monkeypatch):
    monkeypatch.setattr("seqsys.llm.leaks.SEGMENT_TOKENS", 500)
    rng = random.Random(25)
    passages = {i: [sentence(rng, f"Item{i}x") for _ in range(5)] for i in range(12)}
    docs = [(i, " ".join(sentence(rng, f"Doc{i}x") for _ in range(12))) for i in range(60)]
    docs += [(100 + i, f"{sentence(rng, 'A')} {' '.join(passages[i])}") for i in range(12)] + [(200, docs[0][1] * 50 + " ".join(passages[5]))]
    d, t = leak_tables(spark, docs, passages)
    scratch = Scratch(spark, "test")
    index = positional_index(d, doc="id", text="text", raw="raw", scratch=scratch)
    assert index.select("segment").distinct().count() > 10
    for some in ("item < 6", "item >= 6", "item < 0"):
        got = leaks_in_index(index, t.filter(some), item="item", passage="passage", question="question", scratch=scratch)
        want = {(100 + i, i) for i in range(12) if eval(some, {"item": i})} | ({(200, 5)} if some == "item < 6" else set())
        assert {tuple(r) for r in got.collect()} == want


def test_leaks_with_misleading_or_no_neighbouring_words(spark):
    rng = random.Random(22)
    passages = {i: [sentence(rng, f"Item{i}x") for _ in range(5)] for i in range(30)}
    docs = [(i, " ".join(sentence(rng, f"Doc{i}x") for _ in range(12))) for i in range(300)]
    filler = lambda n: " ".join(sentence(rng, "F") for _ in range(n))
    other = {"near": "beside", "measured": "gauged", "while": "whereas", "tested": "tried"}

    def page(item, strays, changed):
        s = [x.split() for x in reversed(passages[item])]
        s[2] = [changed if changed and k == 6 else other.get(w, w) for k, w in enumerate(s[2])]
        return " ".join(f"{filler(2)} {' '.join(passages[item][2].split()[5:7])}." for _ in range(strays)) + " ".join(f"{filler(3)} {' '.join(x)}" for x in s)

    docs += [(1000, page(3, 6, None)), (1001, page(4, 0, "things"))]  # the same two words six times before; no two words left together
    d, t = leak_tables(spark, docs, passages)
    assert {tuple(r) for r in leaks(d, t, **LEAK_COLUMNS).collect()} == {(1000, 3), (1001, 4)}


def test_leaks_scattered_and_altered(spark):
    rng = random.Random(23)
    passages = {i: [sentence(rng, f"Item{i}x") for _ in range(5)] for i in range(30)}
    docs = [(i, " ".join(sentence(rng, f"Doc{i}x") for _ in range(12))) for i in range(300)]
    altered = [s.replace("measured", "gauged").replace("tested", "tried") for s in passages[3]]
    docs.append((1000, " ".join(f"{s} {sentence(rng, 'F')} {sentence(rng, 'G')}" for s in reversed(altered))))  # three pairs left of each sentence
    docs.append((1001, altered[0] + " " + docs[0][1] + " " + altered[1]))  # two sentences of five
    d, t = leak_tables(spark, docs, passages)
    assert {tuple(r) for r in leaks(d, t, **LEAK_COLUMNS).collect()} == {(1000, 3)}



def test_subjects(spark):
    rng = random.Random(12)
    vocabulary = {"science": NOUNS, "law": ["verdict", "statute", "tribunal", "plaintiff", "clause", "docket", "lease", "affidavit"],
        "food": ["oven", "butter", "garlic", "dough", "basil", "yeast", "pickle", "broth"]}
    menu = "Home | Science | Law | Food\nWe use cookies to improve your visit in this kitchen oven\n"

    def prose(s, n):
        return " ".join(f"Some call {rng.choice(vocabulary[s])} {i} near Na{rng.randrange(10**5)} a {rng.choice(vocabulary[s])}, others a {rng.choice(vocabulary[s])}." for i in range(n))

    docs, labels, truth = [], [], {}
    for i in range(600):
        s = rng.choice(list(vocabulary))
        docs.append((i, menu + prose(s, 8)))
        truth[i] = {s}
        if i % 2 == 0:
            labels.append((i, f" {s.upper()} " if i % 5 else s))
    labels += [(0, "none"), (2, None), (None, "law"), (4, "unheard of")] + labels[:10]
    docs += [(1000, menu + prose("law", 8) + prose("food", 7)), (1001, menu), (1002, None), (1003, ""), (1004, menu + prose("law", 400)),
        (1005, menu + prose("science", 20) + prose("law", 1))]
    truth |= {1000: {"law", "food"}, 1001: set(), 1002: set(), 1003: set(), 1004: {"law"}, 1005: {"science"}}
    d = spark.createDataFrame([(*x, None, "x") for x in docs], "id long, text string, raw binary, subject string")
    lab = spark.createDataFrame(labels, "id long, subject string")
    kw = dict(doc="id", text="text", raw="raw", label_doc="id", label="subject", allowed=list(vocabulary))
    got = {}
    for r in subjects(d, lab, **kw).collect():
        got.setdefault(r.doc, set()).add(r.subject)
    wrong = [i for i, s in truth.items() if got.get(i, set()) != s]
    assert not [i for i in wrong if i >= 1000] and len(wrong) < 6
    assert subjects(d.limit(0), lab, **kw).count() == 0 and subjects(d, lab.limit(0), **kw).count() == 0


def test_subjects_of_near_copies(spark):
    rng = random.Random(31)
    vocabulary = {"science": NOUNS, "law": ["verdict", "statute", "tribunal", "plaintiff", "clause", "docket", "lease", "affidavit"],
        "food": ["oven", "butter", "garlic", "dough", "basil", "yeast", "pickle", "broth"]}
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(4))
    menu = "Home | Science | Law | Food\nWe use cookies to improve your visit\n"
    line = lambda s: f"{word()} {rng.choice(vocabulary[s])} {word()} {rng.choice(vocabulary[s])} {rng.choice(vocabulary[s])}\n"
    docs, labels = [], []
    for i in range(600):
        s = rng.choice(list(vocabulary))
        docs.append((i, menu + "".join(line(s) for _ in range(12))))
        labels.append((i, s))
    hot = [line("law") for _ in range(12)]
    docs += [(1000 + i, f"{word()} | {word()}\n" + menu + "".join(hot) + f"printed {word()} {word()}") for i in range(200)]
    d = spark.createDataFrame([(*x, None) for x in docs], "id long, text string, raw binary")
    lab = spark.createDataFrame(labels, "id long, subject string")
    scratch = Scratch(spark, "test")
    found = set(boilerplate_keys(scratch.write(cut_pages(d, "id", "text", "raw")), SubjectRules(), scratch).tolist())
    assert set(cut(["home | food\nwe use cookies to improve your visit"])[2].tolist()) <= found
    assert not set(cut(["".join(hot)])[2].tolist()) & found
    got = subjects(d, lab, doc="id", text="text", raw="raw", label_doc="id", label="subject", allowed=list(vocabulary)).filter("doc >= 1000").collect()
    assert {(r.doc, r.subject) for r in got} == {(1000 + i, "law") for i in range(200)}


@pytest.mark.parametrize("repeats", [2, 4])
def test_subjects_with_a_long_footer_and_capitals(spark, repeats):
    """A footer full of legal terms is boilerplate whatever its length; subjects come back as they are given."""
    rng = random.Random(32)
    vocabulary = {"Science": NOUNS, "Law": ["verdict", "statute", "tribunal", "plaintiff", "clause", "docket", "lease", "affidavit"],
        "Food  and drink": ["oven", "butter", "garlic", "dough", "basil", "yeast", "pickle", "broth"]}
    footer = "\n" + "Any verdict of a tribunal on a clause of this lease binds the plaintiff by statute, says " * repeats
    docs, labels = [], []
    for i in range(600):
        s = rng.choice(list(vocabulary))
        docs.append((i, " ".join(f"Some call {rng.choice(vocabulary[s])} {i} near Na{rng.randrange(10**5)} a {rng.choice(vocabulary[s])}, others a {rng.choice(vocabulary[s])}." for _ in range(8)) + footer))
        labels.append((i, s))
    d = spark.createDataFrame([(*x, None) for x in docs], "id long, text string, raw binary")
    lab = spark.createDataFrame([(i, s.upper() if i % 3 else f" {s.lower()}\t") for i, s in labels], "id long, subject string")
    got = {}
    for r in subjects(d, lab, doc="id", text="text", raw="raw", label_doc="id", label="subject", allowed=[*vocabulary, None, " "]).collect():
        got.setdefault(r.doc, []).append(r.subject)
    assert got == {i: [s] for i, s in labels}


def test_pages_cut_in_small_groups(spark, monkeypatch):
    docs = [(i, "|".join(f"piece{'x' * (i % 5)} of{'y' * k}" for k in range(i % 7)) or " ", None) for i in range(200)] + [(999, "very long " * 20_000,
        None), (1000, None, None), (None, "x", None)]
    d = spark.createDataFrame(docs, "id long, text string, raw binary").coalesce(2)
    rows = lambda: {r.page: (r.of, r.pieces, r.sizes, r.terms, r.bodies) for r in cut_pages(d, "id", "text", "raw").collect()}
    at_once = rows()
    monkeypatch.setattr("seqsys.llm.subjects.CUT_BYTES", 50)
    assert rows() == at_once and set(at_once) == {*range(200), 999} and len(at_once[999][3]) == 40_000


def test_cut():
    terms, size, key, letters, text = cut(["Home | Home 12\nnews", "", "123 |", "home"])
    assert size.tolist() == [1, 1, 1, 1] and text.tolist() == [0, 0, 0, 3] and letters.tolist() == [4, 4, 4, 4]
    assert key[0] == key[1] == key[3] != key[2] and len(terms) == 4
    assert cut(["a b"])[2][0] != cut(["b a"])[2][0]
    assert all(len(x) == 0 for x in cut([])) and all(len(x) == 0 for x in cut(["", "1"]))
