from __future__ import annotations

import os

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from pointlake.llm import leakage, lexicon, sentences, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary")


# -- lexicon and tokens ---------------------------------------------------------------------------------------------------


@given(st.dictionaries(st.binary(max_size=6), st.lists(st.integers(0, 1000), max_size=4), max_size=60), st.lists(st.binary(max_size=7), max_size=30))
@settings(max_examples=60, deadline=None)
def test_lexicon_finds_exactly_its_words(entries, others):
    built = lexicon.build(entries)
    words = [*entries, *others]
    for w, p in zip(words, lexicon.find(built, words)):
        assert (p >= 0) == (w in entries)
        if p >= 0:
            assert built["ids"][built["start"][p] : built["start"][p + 1]].tolist() == entries[w]


def test_lexicon_shares_suffixes(tmp_path):
    built = lexicon.build({f"{a}{b}ing".encode(): [1] for a in "abcd" for b in "efgh"})
    assert len(built["accepts"]) == 6
    path = tmp_path / "lexicon"
    path.write_bytes(lexicon.pack(built))
    again = lexicon.mapped(str(path))
    assert all((again[k] == built[k]).all() for k in built) and lexicon.find(again, [b"aeing", b"ae"]).tolist()[1] == -1


@pytest.fixture(scope="module")
def ranks():
    return tokens.read_ranks(tokens.VOCABULARY)


@given(st.text(max_size=60))
@settings(max_examples=150, deadline=None)
def test_merging_equals_the_public_encoder(text):
    import tiktoken

    r = tokens.read_ranks(tokens.VOCABULARY) if not hasattr(test_merging_equals_the_public_encoder, "r") else test_merging_equals_the_public_encoder.r
    test_merging_equals_the_public_encoder.r = r
    own = [i for w in regex.findall(tokens.PATTERN, text) for i in tokens.merge(w.encode("utf-8", "replace"), r)]
    if not hasattr(test_merging_equals_the_public_encoder, "e"):
        test_merging_equals_the_public_encoder.e = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=r, special_tokens={})
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    assert own == test_merging_equals_the_public_encoder.e.encode_ordinary(text)


def test_token_ids_of_odd_texts(spark, ranks):
    import tiktoken

    public = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {1: "", 2: None, 3: "a <|endoftext|> b", 4: "x" * 30_000, 5: "您好 мир​ 👍🏽\n\n  end ", 6: "the same words the same words", 7: "the same words the same words", 8: " \t"}
    rows = [(k, t, "ids", 3) for k, t in texts.items()] + [(6, texts[6], "ids", 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, word int")
    for most in (50_000, 1):
        got = {r.doc_id: r.ids for r in tokens.token_ids(df, most=most).collect()}
        assert got == {k: public.encode_ordinary(t or "") for k, t in texts.items()}
    assert tokens.token_ids(df.limit(0)).count() == 0


# -- leakage --------------------------------------------------------------------------------------------------------------


def runs(text, n):
    return {text[i : i + n] for i in range(len(text) - n + 1)}


@given(st.lists(st.text("ab ", min_size=0, max_size=60), min_size=1, max_size=6), st.lists(st.text("ab ", max_size=90), min_size=1, max_size=6))
@settings(max_examples=80, deadline=None)
def test_search_loses_nothing_even_in_repetitive_texts(passages, texts):
    p, t = [leakage.reduced(x) for x in passages], [leakage.reduced(x) for x in texts]
    got = set(leakage.Index(list(range(len(p))), p, 12).search(t))
    assert got == {(i, j) for i, x in enumerate(t) for j, y in enumerate(p) if runs(x, 12) & runs(y, 12)}


def test_leaks_through_case_marks_and_width(spark):
    passage = "Nobody in Tolpenny believed that barley could grow behind a lighthouse or a mill."
    odd = "".join(f"{c}-" if c.isalpha() else c for c in passage.upper())
    docs = [(1, f"Before. {odd} After."), (2, passage[:30]), (3, None), (4, ""), (5, "ＮＯＢＯＤＹ" + passage[6:]), (6, "x " * 200_000 + passage), (6, "x " * 200_000 + passage)]
    items = [(7, passage, "Who believed it?", "barley"), (7, passage, "Who believed it?", "barley"), (8, None, None, None), (9, "short", "", "")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as passage", "2 as i", "3 as p")
    i = spark.createDataFrame(items, "item_id bigint, passage string, question string, answer string").selectExpr("*", "1 as text", "2 as doc")
    assert {tuple(r) for r in leakage.leaked(d, i).collect()} == {(1, 7), (5, 7), (6, 7)}
    assert leakage.leaked(d.limit(0), i).count() == 0 and leakage.leaked(d, i.limit(0)).count() == 0
    report = {r.doc_id: r for r in leakage.leak_report(d, i).collect()}
    assert report[6].longest_run == len(leakage.reduced(passage)) and report[6].has_answer and report[6].passage_share == 1.0


def test_many_items_are_searched_index_by_index(spark, monkeypatch):
    monkeypatch.setattr(leakage, "INDEX_ITEMS", 2)
    rng = np.random.default_rng(0)
    passages = ["".join(rng.choice(list("abcdefgh"), 70)) for _ in range(5)]
    d = spark.createDataFrame([(n, p) for n, p in enumerate(passages)], "doc_id bigint, text string")
    i = spark.createDataFrame([(n, p) for n, p in enumerate(passages)], "item_id bigint, passage string")
    assert {tuple(r) for r in leakage.leaked(d, i).collect()} == {(n, n) for n in range(5)}


# -- sentences ------------------------------------------------------------------------------------------------------------

EXAMPLES = [
    ["Dr. Smith came at 5 p.m. on May 3.", "He left."],
    ["It cost $1,219.95 (!) at St. Mary Market.", "See pp. 3 and 4, esp. fig. 15.", "The lid is 3.5 in. wide."],
    ['She said: "It leaks. It always leaks."', "Then she left."],
    ['"Why?" asked the man.', "(It was late.)", "Nobody knew."],
    ["Am 3. Mai kam er, am 21. Juni ging er.", "Der 1. Versuch war gut, vgl. S. 21.", "Das ist z. B. gut."],
    ["« Attends… encore ? » a dit M. Blanc.", "Quel bon jour !"],
    ["¿Lo viste?", "¡Qué bien!", "Vive en EE. UU. y trabaja.", "Trae tornillos, tapas, etc.", "Nada más."],
    ["В 2019 г. он жил в г. Москве.", "«Опять?!» — вздохнул сосед.", "Винты, провода и т. д.", "Всё."],
    ["Τι ωραία μέρα;", "Ο κ. Νίκος ήρθε."],
    ["هل أشتريه؟", "قال: «ما أجمله!» ثم ضحك.", "وصل الطلب."],
    ["डॉ. राम आए।", "क्या वह गए?"],
    ["good. 👍🏽", "next one! ❤️", "Last one."],
]


@pytest.mark.parametrize("parts", EXAMPLES, ids=range(len(EXAMPLES)))
@pytest.mark.parametrize("gap", [" ", "\n", "\t", "  "])
def test_spaced_scripts(parts, gap):
    text = gap.join(parts)
    assert [text[a:b] for a, b in sentences.split(text)] == parts


@pytest.mark.parametrize("parts", [["邻居说：“真好！我也要买。”", "“坏了。”他只说了这一句。", "（只有三页。）", "升级以后……还是坏。"], ["母は「いいね。欲しい。」と言いました。", "「え？」としか言えません。", "価格は1,200.5円（！）でした。"]])
def test_spaceless_scripts(parts):
    text = "".join(parts)
    assert [text[a:b] for a, b in sentences.split(text)] == parts


def test_thai_particles_and_lists():
    thai = ["เบอร์ 14 ราคา 119.50 บาทครับ", "ส่งเร็วมากค่ะ", "ทำไมไม่มีปุ่มมาด้วยคะ"]
    text = " ".join(thai)
    assert [text[a:b] for a, b in sentences.split(text)] == thai
    items = "- First point\n- Second point.\n1. Third one\n2) Fourth"
    assert [items[a:b] for a, b in sentences.split(items)] == ["- First point", "- Second point.", "1. Third one", "2) Fourth"]


def test_wrapped_lines_and_headings():
    text = "A short heading\n\nThis sentence runs over two\nlines of text. Another\none follows."
    assert [text[a:b] for a, b in sentences.split(text)] == ["A short heading", "This sentence runs over two\nlines of text.", "Another\none follows."]


@given(st.text(alphabet=st.sampled_from(list("aB. \n!?…\"'()«»。“”！​­👍กค่ะ1,-:;")), max_size=80))
@settings(max_examples=300, deadline=None)
def test_every_visible_character_belongs_to_one_sentence(text):
    seen = np.zeros(len(text), dtype=int)
    for a, b in sentences.split(text):
        assert a < b and not text[a].isspace() and not text[b - 1].isspace()
        seen[a:b] += 1
    assert all(n == 1 for c, n in zip(text, seen) if not c.isspace() and c not in "​­") and (seen <= 1).all()


def test_sentence_table(spark):
    rows = [(1, "One. Two."), (1, "One. Two."), (2, None), (3, ""), (4, " \n\t"), (5, "a" * 100_000 + ". " + "Word here. " * 5_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as start_pos")
    got = sentences.sentences(df).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {1: 2, 5: 5001}


@pytest.mark.parametrize(
    "text,pieces",
    [
        ("ဒီပစ္စည်းကောင်းတယ်။ ဈေးလည်းသက်သာတယ်။", ["ဒီပစ္စည်းကောင်းတယ်။", "ဈေးလည်းသက်သာတယ်။"]),
        ("ይህ ጥሩ ነው። በጣም እወደዋለሁ።", ["ይህ ጥሩ ነው።", "በጣም እወደዋለሁ።"]),
        ("Սա լավ է։ Ես գոհ եմ։", ["Սա լավ է։", "Ես գոհ եմ։"]),
        ("See Sect. 4 for details. It works.", ["See Sect. 4 for details.", "It works."]),
        ("东西很好了 我很喜欢", ["东西很好了", "我很喜欢"]),
        ("黑色 手机", ["黑色 手机"]),
        ("これはとても良いです でも高い", ["これはとても良いです", "でも高い"]),
        ("ส่งเร็วมากเลย ผมชอบ", ["ส่งเร็วมากเลย", "ผมชอบ"]),
        ('She said "' + "word " * 200 + 'and left. Then more." and went home. Next one.', None),
    ],
)
def test_scripts_and_long_speech(text, pieces):
    got = [text[a:b] for a, b in sentences.split(text)]
    assert got == pieces if pieces else len(got) == 2 and got[1] == "Next one."


def test_the_lattice_takes_the_division_of_most_evidence(monkeypatch):
    texts = ["He came at 9 p.m. last night, tired... and slept. Dr. Ray vs. Mr. Poe, no. 4! ok. fine", "a.m. or p.m. the shop is open. see fig. 3. etc. and so on.", "В 2019 г. он стоил 17 руб. 50 коп. за штуку. Да... нет."]
    narrow = [sentences.split(t) for t in texts]
    monkeypatch.setattr(sentences, "MARGIN", 1e9)  # every path is followed to the end
    assert narrow == [sentences.split(t) for t in texts]


def test_opening_words_are_counted_in_the_corpus(spark):
    df = spark.createDataFrame([(i, "Zorble is new. Zorble works. The end.", ) for i in range(20)], "doc_id bigint, text string")
    assert sentences.opening_words(df, "text") == {"zorble"}  # an article is no evidence
    assert sentences.opening_words(df.limit(0), "text") == frozenset()


@given(st.lists(st.lists(st.integers(0, 5), min_size=8, max_size=60), min_size=1, max_size=30), st.lists(st.integers(0, 5), min_size=20, max_size=90))
@settings(max_examples=80, deadline=None)
def test_leaps_of_the_search_pass_over_no_item(items, query):
    letters = lambda v: "".join("abcdef"[x] for x in v)
    index = leakage.Index(list(range(len(items))), [letters(v) for v in items], 12)
    terms = np.unique(index._hits(leakage.grams(leakage._codes(letters(query))))[1])
    score = np.zeros(len(items))
    for t in terms:
        a, b = index.post_start[t], index.post_start[t + 1]
        score[index.post_item[a:b]] += index.post_weight[a:b]
    assert sorted(index.wand(terms)) == [i for i in range(len(items)) if score[i] >= index.threshold[i]]


def test_reduced_codes_are_those_of_the_texts():
    texts = ["Straße №5, ①!", None, "", "ﬁne ǅ é", "ABC def 123", "ไทย ครับ"]
    codes, ends = leakage.reduced_codes(texts)
    assert [codes[a:b].tobytes().decode("utf-32-le") for a, b in zip([0, *ends], ends)] == [leakage.reduced(t) for t in texts]


@given(st.text("ab", max_size=40), st.text("ab", max_size=40))
@settings(max_examples=60, deadline=None)
def test_longest_common_run(a, b):
    best = max((n for n in range(leakage.GRAM, len(a) + 1) if any(a[i : i + n] in b for i in range(len(a) - n + 1))), default=0)
    assert leakage._longest_run(a, b) == best


def test_too_many_items_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(leakage, "MOST_ITEMS", 1)
    i = spark.createDataFrame([(1, "a"), (2, "b")], "item_id bigint, passage string")
    with pytest.raises(ValueError):
        leakage.leaked(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"), i)
