import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cardspark.llm import language_id, ngram_join, queries, substring_dedup, toxicity
from cardspark.llm.ngram_join import SignatureTree, bitmap, similar_documents
from cardspark.llm.shingles import shingle_sets
from cardspark.llm.substring_dedup import Units, remove_repeated, repeated_spans, without_spans
from cardspark.llm.url_filter import filter_urls, host_and_path
from tests.llm import helpers

SYLLABLES = {"en": "the an re on in er nd th ing".split(), "de": "sch ung ein ich keit der ver".split(), "fr": "eau oux que les ment aux".split()}
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(draw, n, lang="en"):
    return ["".join(draw.choice(SYLLABLES[lang]) for _ in range(draw.randrange(1, 4))) for _ in range(n)]


def documents(seed, n=120):
    draw = random.Random(seed)
    out = []
    for k in range(n):
        lang = draw.choice(list(SYLLABLES))
        own = words(draw, draw.choice([3, 8, 40, 150]), lang)
        out.append(" ".join(own))
        for _ in range(draw.choice([0, 0, 1, 3])):
            near = list(own)
            for _ in range(draw.randrange(0, 1 + len(own) // 20)):
                near[draw.randrange(len(near))] = "changed"
            out.append(" ".join(near).title() if draw.random() < 0.2 else " ".join(near))
    return out + [None, "", " \t\n", "one", "one", "ONE", "a b c d", "é É x y z", "É É x y z", "w " * 30_000]


@pytest.mark.parametrize("common,chunk,tree", [(256, 512, 2048), (4, 3, 5), (2, 4, 1)])
def test_ngram_join(spark, monkeypatch, common, chunk, tree):
    monkeypatch.setattr(ngram_join, "COMMON_SETS", common)
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    monkeypatch.setattr(ngram_join, "TREE_SETS", tree)
    texts = documents(common)
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in zip(ids, texts)], "doc_id long, text string, n int, key string").repartition(5)
    assert sorted(map(tuple, similar_documents(df).collect())) == helpers.similar_groups(ids, texts)


def test_ngram_join_of_a_shingle_that_does_not_fit_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL_ROWS", 8)
    monkeypatch.setattr(ngram_join, "COMMON_SETS", 4)
    monkeypatch.setattr(ngram_join, "CHUNK", 16)
    draw = random.Random(31)
    own = words(draw, 40)
    near = [" ".join([*own[: draw.randrange(30, 41)], *(f"v{k}x{j}" for j in range(draw.randrange(5)))]) for k in range(150)]
    texts = [*near, *(" ".join(words(draw, 30)) for _ in range(20))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = sorted(map(tuple, similar_documents(df).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found == helpers.similar_groups(range(len(texts)), texts)


def test_ngram_join_of_odd_tables(spark):
    df = spark.createDataFrame([], DOCS)
    assert similar_documents(df).count() == 0
    rows = [(5, "a b c d e f", None, None, 0), (5, "a b c d e f", None, None, 0), (2, "a b c d e f", None, None, 0), (None, "a b c d e f", None, None, 0), (9, "x", None, None, 0)]
    found = sorted(map(tuple, similar_documents(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert found == sorted([(5, 2, 2), (5, 2, 2), (2, 2, 2), (None, 2, None), (9, 1, 9)], key=str)


def test_ngram_join_of_a_null_id_before_its_text(spark):
    own = words(random.Random(12), 60)
    rows = [(None, " ".join(own)), (7, " ".join(own)), (3, " ".join([*own[:-1], "changed"]))]
    found = sorted(map(tuple, similar_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()), key=str)
    assert found == sorted([(None, 56, None), (7, 56, 3), (3, 56, 3)], key=str)


def test_ngram_join_of_variants_of_a_line_in_long_documents(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON_SETS", 8)
    draw = random.Random(11)
    line = words(draw, 10)
    while next(shingle_sets([" ".join(line).encode()])).max() >> 62:  # all stand among a long document's first shingles
        line = words(draw, 10)
    long = [" ".join([*words(draw, 25), *line, *words(draw, 25)]) for _ in range(150)]
    variants = [" ".join([*line, f"v{k}"]) for k in range(200)]
    texts = [*long, *variants]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    expected = helpers.similar_groups(range(len(texts)), texts)
    assert len({least for k, _, least in expected if k >= len(long)}) == 1
    assert sorted(map(tuple, similar_documents(df).collect())) == expected


def test_ngram_join_of_sets_that_meet_by_chance(spark, monkeypatch):
    """One shingle in common makes a large bundle, but only the texts of sets with a possible partner travel, and bitmaps a slice at a time."""
    monkeypatch.setattr(ngram_join, "TREE_SETS", 8)
    monkeypatch.setattr(ngram_join, "SLICE_BYTES", 1)
    monkeypatch.setattr(ngram_join, "SLICE_SHARE", 1)
    draw, travelled, worked = random.Random(5), [], []
    line = words(draw, 5)
    while next(shingle_sets([" ".join(line).encode()]))[0] >> 56:  # stands first
        line = words(draw, 5)
    texts = [" ".join([*words(draw, 20), *line, *words(draw, 20)]) for _ in range(26)]
    texts += [f"{texts[0]} more", f"{texts[0]} and more"]
    with_texts, partnered = ngram_join._with_texts, ngram_join._partnered_across

    def seen(bodies, rows):
        travelled.append(rows.select("member").distinct().count())
        return with_texts(bodies, rows)

    monkeypatch.setattr(ngram_join, "_with_texts", seen)
    monkeypatch.setattr(ngram_join, "_partnered_across", lambda members, percent: worked.append(members.count()) or partnered(members, percent))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, similar_documents(df).collect())) == helpers.similar_groups(range(len(texts)), texts)
    assert travelled and max(travelled) <= 6
    assert len(worked) > 2 and max(worked) < sum(worked)


def test_tree_loses_no_pair():
    draw = random.Random(7)
    texts = [t.encode() for t in documents(3, 60) if t and t.strip()]
    sets = list(shingle_sets(texts))
    import numpy as np

    left = {frozenset(p) for i, j in SignatureTree(np.array([len(s) for s in sets]), [bitmap(s) for s in sets]).pairs(75) for p in zip(i.tolist(), j.tolist())}
    alike = {frozenset((i, j)) for i in range(len(sets)) for j in range(i) if ngram_join.similar(sets[i], sets[j], 75)}
    assert alike and alike <= left
    assert len(left) < len(sets) ** 2 / 4 and draw


def brute_spans(rows, run_words=substring_dedup.RUN_WORDS):
    """Repeated spans by plain loops over all units in rank order."""
    cut = {k: helpers.units(t) for k, t in rows if t}
    first = {}
    for k in sorted(cut):
        for n, (_, _, form, _) in enumerate(cut[k]):
            first.setdefault(form, (k, n))
    out = []
    for k, own in cut.items():
        run = []
        for n, unit in [*enumerate(own), (None, None)]:
            if n is not None and first[unit[2]] != (k, n):
                run.append((unit, first[unit[2]][0]))
                continue
            total = sum(u[3] for u, _ in run)
            strong = sum(u[3] for u, _ in run if u[3] >= substring_dedup.STRONG_WORDS)
            if total >= run_words and 2 * strong >= total:
                out.append((k, run[0][0][0], run[-1][0][1], total, min(f for _, f in run)))
            run = []
    return sorted(out)


def passages(seed):
    draw = random.Random(seed)
    sentence = lambda: " ".join(words(draw, draw.randrange(4, 20))).capitalize() + "."
    shared = [" ".join(sentence() for _ in range(6)) for _ in range(4)]
    rows = []
    for k in range(60):
        parts = [sentence() for _ in range(draw.randrange(0, 12))]
        if draw.random() < 0.5:
            parts.insert(draw.randrange(len(parts) + 1), draw.choice(shared))
        rows.append((k, draw.choice([" ", "\n"]).join(parts)))
    return [*rows, (100, None), (101, ""), (102, "Word " * 3000), (103, shared[0] + "\n" + shared[0])]


def test_repeated_spans(spark):
    rows = passages(5)
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, start int").repartition(4)
    found = repeated_spans(df).select("doc_id", "start", "end", "n_words", "first_doc_id")
    expected = brute_spans(rows)
    assert len(expected) > 10 and sorted(map(tuple, found.collect())) == expected
    spans = {}
    for k, a, b, *_ in expected:
        spans.setdefault(k, []).append((a, b))
    cut = {r.doc_id: r.text for r in remove_repeated(df).collect()}
    assert cut == {k: without_spans(t, spans[k]) if k in spans else t for k, t in rows}
    assert repeated_spans(df.limit(0)).count() == 0 and remove_repeated(df.limit(0)).count() == 0


def test_repeated_lines_and_passages_of_short_units(spark):
    draw = random.Random(21)
    sentence = lambda n: " ".join(words(draw, n)).capitalize() + "."
    line, pair = sentence(7), sentence(3) + " " + sentence(4)
    short = [" ".join(sentence(draw.choice([3, 4, 5])) for _ in range(16)) for _ in range(5)]
    rows, planted = [], []
    for k in range(60):
        what = draw.choice([line, pair, *short])
        rows.append((k, sentence(12) + "\n" + what + "\n" + sentence(9) if what in (line, pair) else sentence(12) + " " + what + " " + sentence(9)))
        planted.append(what)
    found = {r.doc_id: r for r in repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for k, what in enumerate(planted):
        first = planted.index(what)
        if k == first:
            assert k not in found
        else:
            at = rows[k][1].index(what)
            assert (found[k].start, found[k].end, found[k].n_words, found[k].first_doc_id) == (at, at + len(what), len(what.split()), first)


def test_a_sentence_between_glued_borders_of_a_passage_is_found(spark):
    draw = random.Random(23)
    sentence = lambda n: " ".join(words(draw, n)).capitalize() + "."
    parts = [sentence(18) for _ in range(3)]
    rows = [(k, sentence(9)[:-1].lower() + parts[0].lower() + " " + parts[1] + " " + parts[2][:-1] + "and " + sentence(8).lower()) for k in range(12)]
    found = {r.doc_id: (r.start, r.end, r.first_doc_id) for r in repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert found == {k: (t.index(parts[1]), t.index(parts[1]) + len(parts[1]), 0) for k, t in rows if k}


def test_short_units_that_only_repeat_one_by_one_stay(spark):
    draw = random.Random(22)
    own = [" ".join(words(draw, 4)).capitalize() + "." for _ in range(40)]
    rows = [(1, " ".join(own)), (2, "Odd start here. " + " ".join(draw.sample(own, 40)) + " Odd end here.")]
    assert repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_units_are_cut_and_hashed_as_by_hand():
    draw = random.Random(41)
    pieces = [" ", "  ", "\n", "\r\n", ". ", "! ", "?", "Ab", "cd", "É", "éa", "Σίγμα", "x_1", "9", "İ", "—", "Hello there", "Übung", "ŽLUTÝ"]
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randrange(0, 60))) for _ in range(300)] + ["a", "\n", " ", "A b. " * 300, "x" * 3000]
    forms, hashes = {}, {}
    own = Units(texts)
    for k, text in enumerate(texts):
        at = slice(own.bounds[k], own.bounds[k + 1])
        expected = helpers.units(text)
        assert list(zip(own.start[at].tolist(), own.end[at].tolist(), own.words[at].tolist())) == [(a, b, n) for a, b, _, n in expected]
        for (*_, form, _), pair in zip(expected, zip(*(h[at].tolist() for h in own.hashes))):
            assert forms.setdefault(form, pair) == pair and hashes.setdefault(pair, form) == form


def test_stretches_of_all_texts_at_once_are_those_of_each():
    draw = random.Random(42)
    texts = [". ".join(" ".join("w" * draw.randrange(1, 4) for _ in range(draw.randrange(1, 9))) for _ in range(draw.randrange(0, 30))) for _ in range(80)]
    own = Units(texts)
    first, last = own.stretches(25)
    found = set(zip(first.tolist(), last.tolist()))
    expected = {(a + own.bounds[k], b + own.bounds[k]) for k in range(len(texts)) for a, b in substring_dedup.stretches(own.words[own.bounds[k] : own.bounds[k + 1]].tolist(), 25)}
    assert found == expected and expected


def test_columns_with_clashing_names(spark):
    """All columns and rows come through the stages' operators, whatever the columns' names; null ids and repeated rows as well."""
    names = ["id", "t", "h", "l", "y", "key", "score", "rejected", "terms", "start", "end", "text_hash", "first_doc_id", "__id", "__hash", "__digest", "__spans", "n_tokens", "component_id"]
    passage = " ".join(words(random.Random(8), 60)).capitalize() + "."
    rows = [(1, passage), (2, passage + "\nmore"), (2, passage + "\nmore"), (None, passage + "\nlast"), (3, None), (4, ""), (5, "x " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(f"own {c}").alias(c) for c in names))
    cut = remove_repeated(df, spans_column="___spans").drop("___spans")
    assert cut.columns == df.columns
    assert sorted([(r.doc_id, r.text) for r in cut.collect()], key=str) == sorted([(1, passage), (2, "more"), (2, "more"), (None, "last"), (3, None), (4, ""), (5, "x " * 30_000)], key=str)
    assert {r["__id"] for r in cut.collect()} == {"own __id"}
    assert remove_repeated(df.drop("__spans")).columns == [c for c in df.columns if c != "__spans"] + ["__spans"]
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    lexicon = toxicity.fit(df, labels)
    assert toxicity.accepted(df, lexicon).columns == df.columns
    scored = toxicity.score_toxicity(df, lexicon, keep=("doc_id",)).collect()
    assert len(scored) == len(rows) and len({r.score for r in scored if r.doc_id == 2}) == 1
    model = language_id.fit(df.withColumn("lang", F.lit("en")), "text", "lang")
    assert language_id.accepted(df, model).columns == df.columns
    judged = language_id.identify(df, model, keep=("doc_id",)).collect()
    assert len(judged) == len(rows) and {r.lang_pred for r in judged if r.doc_id in (3, 4)} == {"und"}
    assert similar_documents(df).count() == len(rows)


def test_ties_between_languages_go_to_the_first_name(spark):
    df = spark.createDataFrame([(1, "abc abd", "x"), (2, "abc abd", "w"), (3, "abc abd abc", None)] * 8, "doc_id long, text string, lang string")
    model = language_id.fit(df, "text", "lang")
    if model:
        assert {r.lang_pred for r in language_id.identify(df, model).collect()} == {min(model.languages)}


def test_language_models_are_interpolated_kneser_ney():
    draw = random.Random(17)
    order, discount = language_id.ORDER, language_id.DISCOUNT
    corpora = {"a": "abracadabra arcade", "b": "banana bandana cab"}
    grams = {name: {} for name in corpora}
    for name, text in corpora.items():
        padded = " " * order + text + " "
        for k in range(len(padded) - order + 1):
            g = padded[k : k + order]
            grams[name][g] = grams[name].get(g, 0) + 1
    import numpy as np

    names = sorted(corpora)
    counts = {}
    for k, name in enumerate(names):
        for g, c in grams[name].items():
            counts.setdefault(tuple(map(ord, g)), np.zeros(len(names)))[k] = c
    model = language_id.Model(names, {order: counts})
    symbols = len({g[-1] for own in grams.values() for g in own}) + 1

    def tables(own):
        found = {order: own}
        for n in range(order - 1, 0, -1):  # how many different characters stand before
            found[n] = {}
            for g in found[n + 1]:
                found[n][g[1:]] = found[n].get(g[1:], 0) + 1
        return found

    def p(found, n, history, c):
        if not n:
            return 1 / symbols
        lower = p(found, n - 1, history[1:], c)
        after = {g[-1]: k for g, k in found[n].items() if g[:-1] == history}
        total = sum(after.values())
        return lower if not total else max(after.get(c, 0) - discount, 0) / total + discount * len(after) / total * lower

    text = " " + "".join(draw.choice("abcdnr e") for _ in range(60)) + " "
    logs = model.logs(np.array(list(map(ord, text)), dtype=np.uint64))
    for k, name in enumerate(names):
        found, padded = tables(grams[name]), " " * (order - 1) + text
        expected = [p(found, order, padded[i : i + order - 1], padded[i + order - 1]) for i in range(1, len(text))]
        assert np.allclose(np.exp(logs[:, k]), expected, rtol=1e-4)


def test_lexicon_hits_are_those_of_a_plain_scan():
    draw = random.Random(18)
    weights = {" bad ": 2.0, " badl": 3.0, " ug": 1.0, " ugly ": 4.0, " x ": 1.5}
    lexicon = toxicity.Lexicon(weights, ("not bad", "ugly duck"))
    for _ in range(200):
        text = toxicity.folded(" ".join(draw.choice(["bad", "badly", "ugly", "not", "duck", "x", "fine", "ug"]) for _ in range(draw.randrange(0, 12))))
        places = lambda term: [k for k in range(len(text)) if text.startswith(term, k)]
        excused = [(k, k + len(f" {p} ")) for p in lexicon.exceptions for k in places(f" {p} ")]
        best = {}
        for term, weight in weights.items():
            for k in places(term):
                if not any(a <= k and k + len(term) <= b for a, b in excused):
                    best[k] = max(best.get(k, 0.0), weight)
        assert lexicon.hits(text)[0] == sum(best.values())


def test_rows_repeated_under_one_id_are_one_document(spark):
    text = " ".join(words(random.Random(1), 40)).capitalize() + "."
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert [(r.doc_id, r.first_doc_id) for r in repeated_spans(df).collect()] == [(2, 1)]


def test_language_held_out_accuracy(spark):
    draw = random.Random(3)
    rows = [(k, " ".join(words(draw, draw.choice([5, 30, 200]), lang)).capitalize() + ".", lang, "s", 0) for k, lang in enumerate(draw.choice(list(SYLLABLES)) for _ in range(300))]
    odd = [(1000, None, "en", None, 0), (1001, "", None, None, 0), (1002, "12 +- 3", "de", None, 0), (1003, "жщё " * 50, None, None, 0), (1004, "the and " * 20_000, None, None, 0)]
    df = spark.createDataFrame([*rows, *odd], DOCS)
    model = language_id.fit(df.where("doc_id % 4 <> 2"), "text", "lang")
    found = {r.doc_id: r for r in language_id.identify(df, model, keep=("doc_id", "lang")).collect()}
    held = [r for r in rows if r[0] % 4 == 2]
    assert sum(found[r[0]].lang_pred == r[2] for r in held) >= 0.97 * len(held)
    assert not any(found[r[0]].rejected for r in rows)
    assert [found[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and all(found[k].rejected for k in (1000, 1001, 1002, 1003))
    assert found[1004].lang_pred == "en" and not found[1004].rejected
    assert all(0 <= r.score <= 1 for r in found.values())
    kept = language_id.accepted(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {k for k, r in found.items() if not r.rejected}
    nothing = language_id.fit(df.limit(0), "text", "lang")
    assert nothing is None and {r.lang_pred for r in language_id.identify(df, nothing).collect()} == {"und"}
    assert language_id.identify(df.limit(0), model).count() == 0


def test_folding():
    assert toxicity.folded("You 1d10t! Ѕtupіd MORON 5cum $cum idi0t l0ser ｌｏｓｅｒ 2024 Привет") == " you 1diot stupid moron scum scum idiot loser loser 2024 привет ".replace("привет", toxicity.folded("a Привет").split()[1])
    assert toxicity.folded("") == "  "


def test_toxicity_held_out_accuracy(spark):
    draw = random.Random(4)
    rows, labels = [], []
    for k in range(600):
        own, bad = words(draw, draw.choice([10, 60, 300])), draw.random() < 0.3
        if bad:
            own[draw.randrange(len(own))] = draw.choice(["grobble", "gr0bble", "ZORKED", "zorked!", "flumphs"])
        rows.append((k, " ".join(own), None, None, 0))
        labels.append((k, int(bad)))
    odd = [(2000, None, None, None, 0), (2001, "", None, None, 0), (2002, "the " * 50_000 + "grobble", None, None, 0)]
    df, marks = spark.createDataFrame([*rows, *odd], DOCS), spark.createDataFrame([*labels, (2000, 1), (2001, 0), (9999, 1)], "doc_id long, toxic int")
    lexicon = toxicity.fit(df, marks.where("doc_id % 5 <> 0"))
    found = {r.doc_id: r for r in toxicity.score_toxicity(df, lexicon, keep=("doc_id",)).collect()}
    held = [(k, y) for k, y in labels if k % 5 == 0]
    assert sum(found[k].predicted == y for k, y in held) >= 0.97 * len(held)
    assert found[2000].predicted == found[2001].predicted == 0 and found[2002].predicted == 1
    kept = toxicity.accepted(df, lexicon)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {k for k, r in found.items() if not r.predicted}
    empty = toxicity.fit(df.limit(0), marks)
    assert empty.weights == {} and {r.predicted for r in toxicity.score_toxicity(df, empty).collect()} == {0}


@pytest.mark.parametrize("rows", [420, 2100])
def test_short_words_can_be_terms_whatever_the_size(spark, rows):
    draw, short = random.Random(9), ("zq", "vex", "yk", "qu")
    own = [words(draw, 12) for _ in range(rows)]
    for n, k in enumerate(range(0, rows, 21)):  # in the smaller table each stands in five rows
        own[k][3] = short[n % 4]
    df = spark.createDataFrame([(k, " ".join(w), None, None, 0) for k, w in enumerate(own)], DOCS)
    lexicon = toxicity.fit(df, spark.createDataFrame([(k, int(k % 21 == 0)) for k in range(rows)], "doc_id long, toxic int"))
    assert {f" {w} " for w in short} <= set(lexicon.weights)
    assert {r.doc_id for r in toxicity.score_toxicity(df, lexicon, keep=("doc_id",)).where("predicted = 1").collect()} == set(range(0, rows, 21))


def test_exception_phrases_excuse_hits():
    lexicon = toxicity.Lexicon({" trash ": 4.0}, ("trash can",))
    assert lexicon.hits(toxicity.folded("the trash can is full"))[0] == 0
    assert lexicon.hits(toxicity.folded("trash, and the trash can"))[0] == 4.0


def test_oracles_are_sql():
    assert queries.oracle_sql() and all(isinstance(sql, str) for sql in queries.oracle_sql().values())
    assert set(queries.oracle_sql()) <= set(queries.queries())


URLS = [
    ("http://m.casino-win.example.com/en/4846#top", "m.casino-win.example.com", "/en/4846", "com/en/", "block"),
    ("http://casino.example.com/en/7?x", "casino.example.com", "/en/7", "example.com/en/7", "allow"),
    ("HTTPS://WWW.Example.NET/de/812", "www.example.net", "/de/812", "example.net/de/8", "block"),
    ("https://xexample.net/de/8", "xexample.net", "/de/8", "net/de/", "allow"),
    ("https://a.org/fr?free-bets", "a.org", "/fr", None, "block"),
    ("https://a.org/freebets/win", "a.org", "/freebets/win", None, "allow"),
    ("https://a.org/adultery", "a.org", "/adultery", None, "allow"),
    ("https://É.org/porn", "É.org", "/porn", None, "block"),
    ("example.com/en/", "", "", None, "allow"),
    ("http://h?a=b/c#d://e/f", "h", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
]


def test_url_filter(spark):
    df = spark.createDataFrame([(k, u[0], "v") for k, u in enumerate(URLS)], "page_id long, url string, verdict string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(df, queries.URL_RULES, keep=("page_id",)).collect()}
    assert found == {k: u[1:] for k, u in enumerate(URLS)}
    assert host_and_path("a://b") == ("b", "")
    assert filter_urls(df.limit(0), queries.URL_RULES).count() == 0


def test_pipeline_stages(spark, tmp_path):
    draw = random.Random(9)
    rows = [(k, re.sub("^.", lambda m: m[0].upper(), " ".join(words(draw, 120, lang))) + ".", lang, "s", 0) for k, lang in enumerate(draw.choice(list(SYLLABLES)) for _ in range(120))]
    passage = " ".join(words(random.Random(8), 60)).capitalize() + "."
    rows[10] = (*rows[10][:1], rows[10][1] + "\n" + passage, *rows[10][2:])
    rows[20] = (*rows[20][:1], rows[20][1] + "\n" + passage, *rows[20][2:])
    rows += [(500, rows[3][1], rows[3][2], "s", 0), (501, rows[4][1].replace(" ", "  "), None, "t", 0), (502, "жщё " * 60, None, None, 0), (503, None, None, None, 0)]
    bad = [(600 + k, " ".join([*words(draw, 50), draw.choice(["grobble", "zorked"])]), "en", "s", 0) for k in range(160)]
    df = spark.createDataFrame([*rows, *bad], DOCS).withColumn("n_chars", F.length("text").cast("long"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], int(r[0] >= 600)) for r in [*rows, *bad] if r[0] % 2], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.checkpointed(stage(spark, docs, str(tmp_path)))
        assert docs.columns == df.columns
        kept[name] = {r.doc_id: r for r in docs.collect()}
    assert set(kept["language_id"]) == {r[0] for r in [*rows, *bad]} - {502, 503}
    assert set(kept["toxicity"]) == {r[0] for r in rows} - {502, 503}
    groups = helpers.similar_groups([r[0] for r in rows[:122]], [r[1] for r in rows[:122]])
    assert set(kept["near_duplicates"]) == {k for k, _, least in groups if k == least}
    assert passage in kept["substring_dedup"][10].text and passage not in kept["substring_dedup"][20].text
    assert kept["substring_dedup"][20].n_chars == len(kept["substring_dedup"][20].text)
    empty = tmp_path / "empty"
    for name in ("documents", "labels"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).limit(0).write.parquet(str(empty / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(kept["substring_dedup"]) and all(r.offset + r.length <= 4096 for r in packed)
