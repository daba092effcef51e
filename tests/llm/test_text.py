"""Operators 1, 5, 8, 9 and 10, and the pipeline."""

import random
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from tickflow.llm import decontam, html, langid, tokens, toxicity
from tickflow.llm.common import scratch_dir, written

# --- html ---------------------------------------------------------------------------------------------------

TREE = html.grow(html.labelled())
PAGES = {
    "<html><head><title>T</title><script>var x='</p>';</script></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav><article><h1>Title</h1><p>One &amp; two<br>three&nbsp;four</p><p>Be.</article><footer>&copy; x</footer>": "Title\nOne & two three four\nBe.",
    "<article><p>a <b>b</b>c</p><div class='share-buttons'><p>Tweet this</p></div><form><label>Mail</label></form><aside>More</aside><p>d</p><section id=comments><p>Nice one!</p></section></article>": "a bc\nd",
    "<!-- ad --><div class=\"ad\">Buy now</div><main><p>Text<p>More text</main><p": "Text\nMore text",
    "<nav>only a menu</nav>": "",
    "<body class='has-sidebar comments-open'><article class='page-with-sidebar'><header class='entry-header'><h1>Head</h1></header><p>Body</p></article><div class='sidebar'><p>Side</p></div>": "Head\nBody",
    "": "",
    None: "",
    "<article><p>cut &am": "cut &am",
    "<article><p>unclosed <a href='x": "unclosed",
    "<ARTICLE><P>Upper &lt;b&gt; &#233;&#x41;</P></ARTICLE>": "Upper <b> éA",
}


def test_pages(spark):
    rows = [(k, None if k % 2 else f"u{k}", page, "clash", k) for k, page in enumerate(PAGES)] + [(None, None, "<article>x</article>", None, None), (0, "u0", next(iter(PAGES)), None, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(((r.page_id is None, r.page_id or 0), r.text, r.n_chars) for r in html.extracted(df).collect())
    want = [((False, k), t) for k, t in enumerate(PAGES.values())] + [((True, 0), "x"), ((False, 0), PAGES[next(iter(PAGES))])]
    assert got == sorted((k, t, len(t)) for k, t in want)
    assert html.extracted(df.where("page_id = 99")).count() == 0


def test_tree_fits_its_examples():
    assert all(html.decide(TREE, x) == y for x, y in html.labelled())


def test_numbers_decide_where_no_element_names_itself():
    """Pages whose elements all are of one name: only words and links tell menu, advert and footer from the text."""
    menu = "".join(f"<div><a href=/{k}>Item</a></div>" for k in range(6))
    text = ["Some words make a title here", "A paragraph of the article " + "with more words " * 12, "Another one " + "that goes on " * 9, "Short end of it."]
    page = menu + "<div>Buy this now at once today only</div>" + "".join(f"<div>{t}</div>" for t in text) + "<div>Copyright of the page and all</div>"
    assert html.main_text(page, TREE) == "\n".join(" ".join(t.split()) for t in text)


def test_open_tags_are_left_in_linear_time():
    import time

    begin = time.process_time()
    assert html.main_text("<article>" + "<div>" * 50_000 + "<b>x</b>" * 50_000, TREE) == "x" * 50_000
    assert time.process_time() - begin < 5


LONG = "".join(f"<p>{' '.join(f'{w}{k}' for k in range(n))}</p>" for w, n in (("word", 60), ("more", 72), ("last", 14)))


@pytest.mark.parametrize(
    "page",
    [
        "<head><title>T</title><body><article>%s</article>",
        "<head><title>T</title><meta charset=x><article>%s</article>",
        "<html><body><div class='post share-enabled'><article>%s</article></div>",
        "<body><div class='search-page'><article>%s</article></div><div class='search'><p>Find what you like</p></div>",
        "<body><a name=top><article>%s</article>",
        "<body><div><a href=/x>Home</div><article>%s</article>",
        "<body><main>%s</main>",
    ],
)
def test_omitted_tags_marks_and_anchors_keep_the_article(page):
    """A head that nothing closes, marks on what holds the article, anchors that are no links, and short last paragraphs."""
    text = html.main_text(page % LONG, TREE)
    assert [len(t.split()) for t in text.split("\n") if t.startswith(("word", "more", "last"))] == [60, 72, 14]
    assert "Find" not in text and "T" not in text.split()


@given(st.text(alphabet="<>/=\"' apdivh1!-&;x\n", max_size=200))
@settings(max_examples=300, deadline=None)
def test_any_markup_is_read_to_its_end(page):
    html.main_text(page, TREE)


# --- decontamination ----------------------------------------------------------------------------------------


def plain_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != t))
    return min(row)


@given(st.text("abc", min_size=1, max_size=80), st.text("abc", max_size=120))
@settings(max_examples=200, deadline=None)
def test_myers_distance(pattern, text):
    assert decontam.myers(pattern, text)[0] == plain_distance(pattern, text)


@pytest.mark.parametrize("block_chars", [10**6, 300])
def test_contaminated_equals_brute_force(spark, make_docs, block_chars):
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([5, 12, 30, 50])))) for k in range(15)] + [(90, None), (91, ""), (92, "tiny"), (3, "tiny again")]
    docs = [(1, None), (2, ""), (None, "before " + items[4][1].upper() + " after")]
    for k in range(60):
        item, edited = rng.choice(items[:15])[1], None
        edited = list(item)
        for _ in range(rng.randint(0, 12)):
            edited[rng.randrange(len(edited))] = rng.choice("xyz ")
        docs.append((10 + k, " ".join(rng.choice(words) for _ in range(30)) + "\n" + "".join(edited) + " \t " + " ".join(rng.choice(words) for _ in range(20))))
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id int, text string, doc_id int")
    got = sorted((str(r.doc_id), r.item_id, r.distance) for r in decontam.contaminated(make_docs(docs), bench, block_chars=block_chars).collect())
    want = []
    for i, text in docs:
        for k, item in items:
            item = decontam.normal(item)
            if len(item) >= 20 and (d := plain_distance(item, decontam.normal(text))) <= len(item) // 20:
                want.append((str(i), k, d))
            elif 0 < len(item) < 20 and f" {item} " in f" {decontam.normal(text)} ":
                want.append((str(i), k, 0))
    assert got == sorted(want) and len(want) > 20
    assert decontam.contaminated(make_docs(docs).where("doc_id = 0"), bench).count() == 0
    assert decontam.contaminated(make_docs(docs), bench.where("item_id > 80 and item_id < 92")).count() == 0


def test_short_items_stand_as_whole_words(spark, make_docs):
    docs = make_docs([(1, "so tiny."), (2, "destiny, tinys"), (3, "destiny (TINY)"), (4, "これは何ですかと"), (5, "tiny")])
    bench = spark.createDataFrame([(1, "tiny"), (2, "何ですか"), (3, " "), (4, None)], "item_id int, text string")
    found = decontam.contaminated(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.distance, r.match_end) for r in found) == [(1, 1, 0, 7), (3, 1, 0, 13), (4, 2, 0, 7), (5, 1, 0, 4)]


# --- token files --------------------------------------------------------------------------------------------

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def direct(texts):
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_the_library(monkeypatch):
    rng = random.Random(1)
    parts = ["a", "word", " ", "  ", "\n", "\t", "12", "٣", "é", "中文", "!", "<|endoftext|>", "'s", "'", "’", "\xa0", " ", "½", "😀", "_", "​", "é", "\r\n", "\x85", "\x1c", ""]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 15))) for _ in range(3000)]
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    encoder = tokens.Encoder(VOCABULARY)
    for k in range(0, 3000, 500):
        ids, counts = encoder.encode(texts[k : k + 500])
        assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == direct(texts[k : k + 500])


@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=3000), st.integers(0, 17))
@settings(max_examples=50, deadline=None)
def test_blocks_round_trip(values, shift):
    ids = np.array(values, np.uint32) >> shift
    data, index = tokens.pack_ids(ids)
    assert (tokens.unpack_ids(data, index) == ids).all()
    a, b = len(ids) // 3, len(ids) // 2
    assert (tokens.unpack_ids(data, index, a, b) == ids[a:b]).all()


def test_token_files(spark, odd_docs, no_docs, monkeypatch):
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in odd_docs.collect()))
    want, start = [], 0
    for (known, i, _), ids in zip(rows, direct([t for *_, t in rows]), strict=True):
        ids = np.array([*ids, 0], "<u4")
        want.append((known, i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    for n, docs in (("a", odd_docs), ("b", no_docs)):
        path = f"{scratch_dir(spark)}/tokens-test-{n}-{uuid.uuid4().hex}"
        tokens.write_token_files(docs, path, VOCABULARY, partitions=3)
        got = [(r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in tokens.read_token_files(spark, path).collect()]
        assert sorted(got, key=lambda r: r[2]) == (want if n == "a" else [])


# --- language -----------------------------------------------------------------------------------------------


def language_rows(n):
    rng = random.Random(3)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ein", "ung"], "cc": ["é", "oux", "tion"]}
    for k in range(n):
        lang = rng.choice(list(syllables))
        yield k, " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(rng.randint(2, 40))), lang


def test_language_held_out(make_docs, odd_docs, no_docs):
    docs = make_docs([*language_rows(300), (900, None, "aa"), (901, "12 !", "bb"), (902, "", None), (None, "ka lo", None)])
    out = langid.predicted(docs).collect()
    truth = {k: lang for k, _, lang in language_rows(300)}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 40 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out if r.doc_id is not None)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(r.lang_pred == "und" and r.rejected for r in out if r.doc_id in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in out) and len(out) == 304
    assert langid.predicted(odd_docs).count() == odd_docs.count() and langid.predicted(no_docs).count() == 0
    assert {r.lang_pred for r in langid.identified(docs, None).collect()} == {"und"}


def test_rare_languages_are_drawn(make_docs):
    docs = make_docs([*((k, f"word {k}", "aa") for k in range(3000)), *((k, f"rare {k}", "zz") for k in range(3000, 3012))])
    drawn = langid.training_rows(docs, 200, "text", "lang", "doc_id")
    assert sum(lang == "zz" for _, lang in drawn) == 12 and 100 < sum(lang == "aa" for _, lang in drawn) < 300
    assert {lang for _, lang in langid.training_rows(docs, 200, "text", "lang", "doc_id", most_labels=1)} == {"aa"}


# --- toxicity -----------------------------------------------------------------------------------------------


def plain_edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@given(st.sets(st.text("abc", min_size=1, max_size=6), min_size=1, max_size=8), st.text("abc", max_size=7))
@settings(max_examples=200, deadline=None)
def test_automaton_on_trie(terms, word):
    lexicon = toxicity.Lexicon({t: 1.0 for t in terms}, {})
    assert set(toxicity.within_one_edit(word, lexicon.trie)) == {t for t in terms if plain_edit(t, word) <= 1}


def toxic_rows(n):
    rng = random.Random(5)
    bad, good = ["grumbel", "zonkish"], [f"word{k}" for k in range(200)]
    for k in range(n):
        words = [rng.choice(good) for _ in range(rng.randint(10, 60))]
        y = int(rng.random() < 0.25)
        if y:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        yield k, " ".join(words), y


def test_toxicity_held_out_and_misspelled(spark, make_docs, no_docs):
    rows = list(toxic_rows(600))
    docs = make_docs([(k, t) for k, t, _ in rows] + [(5000, None), (5001, ""), (5002, "some grumbol and zonkisch grumbl here"), (None, "word1 grumbel zonkish grumbel")])
    labels = spark.createDataFrame([(k, 1, y, "clash") for k, _, y in rows] + [(7, 0, None, ""), (None, 0, 1, "")], "doc_id long, quality int, toxic int, text string")
    out = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [(k, y) for k, _, y in rows if out[k].held_out]
    assert len(held) > 100 and all(out[k].predicted == y for k, y in held)
    assert out[5002].predicted == 1 and out[None].predicted == 1
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out.values())
    assert out[5000].score == out[5001].score < 0.3
    assert toxicity.toxicity(docs, labels.where("doc_id < 0")).count() == docs.count()
    assert toxicity.toxicity(no_docs, labels).count() == 0


def test_quotation_and_edits_of_a_hit():
    lexicon = toxicity.Lexicon({"grumbel": 2.0}, {"zonk": 1.0})
    evidence = lambda text: float(np.expm1(toxicity.features(text, lexicon)[0]))
    assert np.isclose(evidence("you are a grumbel today"), 2) and np.isclose(evidence("you are a grumbl today"), 2 * toxicity.EDITED)
    for text in ('they wrote "you grumbel" on the wall', "he said you are a grumbel today", "er sagte du bist ein grumbel"):
        assert np.isclose(evidence(text), 2 * toxicity.QUOTED) and toxicity.features(text, lexicon)[1] == 0
    assert evidence("zonk") == 0 and np.isclose(evidence("zonkish"), 1)
    own = toxicity.Lexicon({"grumbel": 2.0}, {}, frozenset(["grummel"]))
    assert own.match("grummel") is None and own.match("grumbex") == (2.0, False)


def test_misspelt_terms_score_near_exact_ones_and_quoted_ones_low():
    model = toxicity.fit([(t, y) for _, t, y in toxic_rows(600)], 0.3)
    assert (model.weights >= 0).all() and model.weights.any()
    fill = [f"word{k % 50}" for k in range(150)]

    def score(n, *terms):
        middle = n // 2
        return model.score(" ".join([*fill[:middle], *terms, *fill[middle:n]]))

    for n in (10, 40, 150):
        exact, edited, quoted = score(n, "grumbel", "zonkish"), score(n, "grumbbel", "zonkixh"), score(n, '"grumbel', 'zonkish"')
        assert exact > 0.7 and exact - edited < 0.1 and quoted < exact - 0.3, (n, exact, edited, quoted)


# --- pipeline -----------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf_dir, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).unionByName(odd_docs.select("doc_id", "text", "lang", "source", "n_chars"))
    for start in (docs, no_docs):
        current = written(start)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES, 1):
            out = written(stage(spark, current, sf_dir))
            if k < len(corpus_pipeline.STAGES):
                assert out.columns == start.columns
            else:
                assert out.count() == current.count()
            current = out


def test_stage_decisions(spark, sf_dir, make_docs):
    item = next(r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if len(r.text) > 100)
    words = [f"w{k}" for k in range(300)]
    docs = make_docs([(1, " ".join(words)), (2, " ".join(words) + " "), (3, " ".join(words[::-1]) + item), (4, None), (5, "a b c")])
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()) == [1, 3, 4, 5]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_benchmark(spark, docs, sf_dir).collect()) == [1, 2, 4, 5]


def test_harmless_words_with_the_beginning_of_a_term(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learned(docs, labels)
    assert model.score("A worker in the world works with patterns of words") < 0.3
    assert model.score("The worst of the patent work was lost in the morning of a studio") < 0.3
    assert all(len(s) >= 5 for s in model.lexicon.stems)


def test_pipeline_toxicity_stage_drops_what_the_operator_rejects(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, sf_dir).collect()}
    rejected = {r.doc_id for r in toxicity.scored(docs, toxicity.learned(docs, labels)).where("predicted = 1").collect()}
    every = {r.doc_id for r in docs.collect()}
    assert kept == every - rejected and rejected
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert sum(truth.get(i) == 0 for i in rejected) <= 1
