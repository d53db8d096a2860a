"""Brute force on whole small tables, crowds of alike documents, and the odd cases that docstrings define."""

import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tickwell.llm import ann, decontaminate, html_extract, language_id, mixing, near_dedup, queries, token_counts, token_output, toxicity, url_filter
from tickwell.llm.common import discard, fresh, materialise, scratch

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


def sentence(seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def shingles(text):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups(rows):
    """doc ids -> smallest id reachable over links of 0.75, for (id, text) rows; pairs are those that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    held, root = defaultdict(list), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, s in enumerate(sets):
        met = Counter(j for x in s for j in held[x])
        for j, n in met.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
        for x in s:
            held[x].append(i)
    low = defaultdict(lambda: None)
    for i, (own, _) in enumerate(rows):
        k = find(i)
        if own is not None:
            low[k] = own if low[k] is None else min(low[k], own)
    return [low[find(i)] for i in range(len(rows))], sets


def test_near_duplicates_of_a_whole_table_equal_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    want, sets = groups(rows)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(table).collect()}
    assert {d: got[d].component_id for d, _ in rows} == dict(zip([d for d, _ in rows], want, strict=True))
    assert all(got[d].n_shingles == len(s) for (d, _), s in zip(rows, sets, strict=True))


def test_crowd_with_a_common_passage_is_not_paired(spark, monkeypatch):
    """500 unlike documents share most of their text, 60 more are near copies of one another."""
    common, r = sentence(7, 60), random.Random(3)
    texts = [f"{common} {sentence(100 + i, 30)}" for i in range(500)]
    base = sentence(8, 80).split()
    for _ in range(60):
        own = list(base)
        for _ in range(r.choice((1, 2, 3, 4))):
            own[r.randrange(80)] = f"w{r.random()}"
        texts.append(" ".join(own))
    made, real = [], near_dedup.prefix_pairs
    monkeypatch.setattr(near_dedup, "prefix_pairs", lambda *a: made.append(materialise(real(*a), "pairs")) or made[-1])
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(table).collect()}
    assert [got[i] for i in range(len(texts))] == groups(list(enumerate(texts)))[0]
    assert made[0].count() < 2000  # all pairs are 124,750


def test_prefix_pairs_miss_no_pair(spark):
    r = random.Random(5)
    sets = [set(r.sample(range(60), r.randrange(1, 40))) for _ in range(60)]
    sets += [(s | set(r.sample(range(60, 200), 3))) - set(r.sample(sorted(s), min(2, len(s) - 1))) for s in sets]
    df = spark.createDataFrame([(i, len(s), i, sorted(s)) for i, s in enumerate(sets)], "rep long, n int, component long, s array<long>")
    got = {tuple(sorted((x.a, x.b))) for x in near_dedup.prefix_pairs(df, 75).collect()}
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert want and want <= got


def test_near_duplicates_odd_ids(spark):
    a, b = sentence(1), sentence(2)
    near = a.split()
    near[30] = "other"
    rows = [(None, a), (5, a), (5, b), (7, " ".join(near)), (None, sentence(3)), (9, None), (None, ""), (8, b), (3, sentence(4, 50_000)), (2, sentence(4, 50_000))]
    table = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, rep int, th string, component_id int")
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(table).collect())
    assert got == Counter([
        (None, 56, 5, False), (5, 56, 5, True), (5, 56, 5, True), (7, 56, 5, False), (None, 56, None, True), (9, 0, 9, True), (None, 0, None, True), (8, 56, 5, False),
        (3, 49996, 2, False), (2, 49996, 2, True),
    ])
    assert near_dedup.near_duplicates(table.limit(0)).count() == 0


def weighted_leaks(docs, items, similarity=0.75):
    """(doc, item) pairs by trying every window of every document."""
    bags = {i: Counter(tuple(x[k : k + min(5, len(x))]) for k in range(max(1, len(x) - 4))) for i, x in items.items()}
    held = Counter(s for b in bags.values() for s in b)
    weigh = lambda s: np.log(1 + len(items) / held[s]) if s in held else np.log(1 + len(items))
    out = set()
    for d, x in docs.items():
        for i, b in bags.items():
            n = min(5, len(items[i]))
            own = [tuple(x[k : k + n]) for k in range(len(x) - n + 1)]
            k, hits = sum(b.values()), [j for j, s in enumerate(own) if s in b]
            near = {at for j in hits for at in range(max(0, j - k + 1), j + 1)}  # windows that share a shingle; others have similarity 0
            for at in sorted(x for x in near if x <= max(0, len(own) - k)):
                w = Counter(own[at : at + k])
                both = sum(weigh(s) * min(c, w[s]) for s, c in b.items())
                total = sum(weigh(s) * c for s, c in b.items()) + sum(weigh(s) * c for s, c in w.items()) - both
                if both and both / total >= similarity - 1e-12:
                    out.add((d, i))
                    break
    return out


def test_leaks_equal_every_window_tried(spark):
    r = random.Random(11)
    items = {i: sentence(500 + i, r.choice((3, 12, 40, 41))).split() for i in range(25)}
    docs = {}
    for d in range(120):
        own = list(items[d % 25])
        for _ in range(r.choice((0, 0, 1, 1, 2))):
            own[r.randrange(len(own))] = f"e{r.random()}"
        docs[d] = sentence(9000 + d, 30).split() + own + sentence(9500 + d, 20).split()
    table = spark.createDataFrame([(d, " ".join(x), 1) for d, x in docs.items()], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(table, bench).collect()}
    want = weighted_leaks(docs, items)
    assert want and got == want


def test_leaks_with_words_put_in_and_left_out_equal_every_window_tried(spark):
    """Items of one template (common head and tail); one to four words inserted or deleted, halves swapped."""
    r = random.Random(4)
    head, tail = "which of the following".split() + ["is"], "choose the best answer now".split()
    items = {i: head + sentence(700 + i, 31).split() + tail for i in range(100)}
    docs = {}
    for d in range(56):
        own = list(items[d % 100])
        at, n = r.randrange(12, 26), 1 + d % 4
        if d % 3 == 2:
            del own[at : at + n]
        elif d % 13 == 0:
            own = own[20:] + own[:20]
        else:
            own[at:at] = [f"new{d}x{k}" for k in range(n)]
        docs[d] = sentence(3000 + d, 25).split() + own + (sentence(3500 + d, 20).split() if d % 5 else [])
    docs[56] = items[0] + items[1] + items[2]
    docs[57] = head + tail + sentence(4000, 60).split() + head
    table = spark.createDataFrame([(d, " ".join(x)) for d, x in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()], "item_id long, text string")
    got = decontaminate.find_leaks(table, bench).collect()
    want = weighted_leaks(docs, items)
    assert {(x.doc_id, x.item_id) for x in got} == want
    assert sum(1 for d, _ in want if d % 4 == 1 and d % 3 != 2) > 2 and {(56, 0), (56, 1), (56, 2)} <= want
    assert sum(x.hamming is not None for x in got) > 0.5 * len(got)  # fingerprints carry the main load


def test_leaks_odd_cases(spark):
    bench = spark.createDataFrame([(1, sentence(1, 40)), (1, sentence(1, 40)), (2, None), (3, " ")], "item_id long, text string")
    rows = [(None, sentence(1, 40)), (4, sentence(1, 40)), (4, sentence(2)), (5, None), (6, ""), (7, sentence(3, 20_000) + " " + sentence(1, 40))]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, th string, item_id int")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(table, bench).collect()} == {(None, 1), (4, 1), (7, 1)}
    left = decontaminate.decontaminate(table, bench)
    assert left.columns == table.columns and Counter((r.doc_id, r.text) for r in left.collect()) == Counter([(4, sentence(2)), (5, None), (6, "")])
    assert decontaminate.find_leaks(table.limit(0), bench).count() == 0 and decontaminate.find_leaks(table, bench.limit(0)).count() == 0


def test_eighty_languages_are_all_learnt(spark):
    def word(lang, r):
        return "".join(chr(97 + (lang * 7 + r.randrange(4) * (1 + lang % 5)) % 26) for _ in range(6)) + chr(0x3B1 + lang % 20)

    rows = [(lang * 10 + k, " ".join(word(lang, random.Random(lang * 100 + k * 7 + i)) for i in range(60)), f"l{lang:02d}") for lang in range(80) for k in range(6)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(table, F.col("doc_id") % 10 < 4)
    told = language_id.identify(table.filter("doc_id % 10 >= 4").withColumn("score", F.lit(1)), model, lang_as="guess", score_as="sure").collect()
    assert len(model.langs) == 80 and np.mean([r.guess == r.lang for r in told]) > 0.9


def test_language_odd_cases(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id.learn(none, F.lit(True)) is None
    table = spark.createDataFrame([(1, "abc", "b"), (2, "abc", "a"), (2, "abc", "a"), (3, "abc", None)], "doc_id long, text string, lang string")
    model = language_id.learn(table, F.lit(True))
    got = language_id.identify(table, model).collect()
    assert len(got) == 4 and {r.lang_pred for r in got} == {"a"} and language_id.identify(none, model).count() == 0


def test_toxicity_on_held_out_rows_and_odd_cases(spark):
    told = queries.op6_toxicity(spark, SF)
    labels, docs = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = told.join(labels, "doc_id").join(docs, "doc_id").filter("held_out AND lang = 'en'").collect()
    toxic, clean = [r.predicted for r in rows if r.toxic], [r.predicted for r in rows if not r.toxic]
    assert len(toxic) >= 5 and np.mean(toxic) >= 0.7 and np.mean(clean) <= 0.05
    table = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    for marks, want in ((none, 0), (one, 1)):
        got = toxicity.score(table, toxicity.learn(table, marks, lambda n: F.lit(True)), ["doc_id"]).collect()
        assert len(got) == 3 and {r.predicted for r in got} == {want}
    model = toxicity.learn(table.limit(0), none, lambda n: F.lit(True))
    assert toxicity.score(table.limit(0), model, ["doc_id"]).count() == 0


def test_nearest_neighbours_of_a_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    ids, x = zip(*[(r.vec_id, r.embedding) for r in table.collect()], strict=True)
    ids, x = np.array(ids), np.array(x, float)
    got = defaultdict(list)
    for r in queries.op7_ann(spark, SF).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        own = sorted(got[ids[q]])
        assert [k for k, _, _ in own] == list(range(1, 21)) and all(s[ids == v][0] == pytest.approx(c, abs=1e-12) for _, v, c in own)
        hits, total = hits + len(set(best) & {v for _, v, _ in own}), total + 20
    print("recall", hits / total)
    assert hits / total >= 0.9


def test_nearest_neighbours_odd_cases(spark):
    schema = "vec_id long, embedding array<float>, score double"
    ties = spark.createDataFrame([(i, [1.0, 0.0], 1.0) for i in (20, 3, 1, 2)] + [(0, [1.0, 1.0], 1.0), (40, [1.0, 2.0, 3.0], 1.0), (3, [1.0, 0.0], 1.0), (None, [1.0, 1.0], 1.0)], schema)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(ties, F.pmod("vec_id", F.lit(20)) == 0, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 1.0), (20, 1, 0, 1.0), (20, 2, 1, 1.0), (20, 3, 2, 1.0)]
    few = ann.search(ties, F.col("vec_id") == 0, k=50).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 20]
    assert ann.search(ties.limit(0), F.lit(True)).count() == 0


def test_token_counts_of_texts(spark):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    scores, byte, longest = token_counts.pieces(path)
    texts = ["the theory thesis the", None, "", "  ", "naïve 漢字 the", "x" * 5000, "the theory thesis the"]

    def plain(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            size = len(word[end - 1].encode())
            some = [(best[end - 1][0] + byte * size, -(best[end - 1][1] + size))]
            some += [(best[s][0] + scores[word[s:end]], -(best[s][1] + 1)) for s in range(max(0, end - longest), end) if word[s:end] in scores]
            top = max(some)
            best.append((top[0], -top[1]))
        return best[-1][1]

    want = [(len(w), sum(plain(token_counts.MARK + x) for x in w)) for w in (re.findall(WORD, t or "") for t in texts)]
    table = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, _text int").drop("_text")
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in token_counts.token_counts(table, path, ["doc_id"]).collect()}
    assert [got[i] for i in range(len(texts))] == want
    whole = queries.op8_token_counts(spark, SMALL)
    assert whole.count() == 200 and whole.agg(F.min(F.col("n_tokens") - F.col("n_pretokens"))).first()[0] >= 0


@pytest.mark.parametrize("html, text", [
    ("<article><p>a b</p><svg/><p>c d</p></article>", "a b\nc d"), ("<article><p>a b</p><iframe src=x><p>c d</p></article>", "a b\nc d"), ("<main class='has-sidebar'><p>Body text here</p></main>", "Body text here"),
    ("<article><div class='article-header'><h1>Head</h1></div><p>Body text</p></article>", "Head\nBody text"), ("<article><p>one</p><div class='share-price'>12 a share</div><p>two</p></article>", "one\n12 a share\ntwo"),
    ("<article><p>text here</p><p><a href=x>a linked paragraph</a></p></article>", "text here\na linked paragraph"), ("<article><p>kept</p><div class='ad-slot'>buy</div></article>", "kept"), ("<article><p>cut o", "cut o"),
])
def test_html_elements(html, text):
    assert html_extract.main_text(html, None) == text


def test_html_rows_and_long_pages(spark):
    page = "<html><nav><a>menu</a></nav><article>" + "".join(f"<p>paragraph {i} {i * i}</p><h2>part {i}</h2>" for i in range(4000)) + "</article></html>"
    rows = [(1, "http://h.example/a", page), (1, "http://h.example/a", page), (2, "http://h.example/b", page.replace("part", "piece")), (3, None, None), (4, "http://h.example/c", "<article><p>x")]
    got = html_extract.extract(spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, host string")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 5 and by[1].text.count("\n") == 7999 and by[3].text == "" and by[4].text == "x" and by[1].n_chars == len(by[1].text)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_mixing_rows(spark):
    rows = [(1, "a b c", "x")] * 3 + [(2, "w " * 100_000, "y"), (None, "d e", None), (3, None, "x")]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, taken int")
    got = mixing.mix(table, prefix="m_")
    assert got.count() == 6 and {"size", "m_size", "m_taken"} <= set(got.columns)
    assert all(0 <= r.m_taken <= 3 * r.m_size for r in got.collect())


def test_urls_and_tokens_of_empty_tables_and_odd_ids(spark):
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    path = queries.tokenizer_path()
    table = spark.createDataFrame([(None, "a b"), (3, "hello"), (3, "hello"), (1, None), (2, "")], "doc_id long, text string")
    got = token_output.token_output(table, path).collect()
    assert len(got) == 5 and Counter(r.n_tokens for r in got)[1] == 2 and len({r.start for r in got}) == 5


def test_helpers(spark):
    assert fresh(["a", "_X"], "_x") == "__x" and fresh([], "x") == "x"
    t = materialise(spark.range(3), "few")
    assert t.count() == 3 and scratch(spark)
    discard(t)
    discard(t)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(t.inputFiles()[0]).count()


def test_pipeline_from_end_to_end(spark):
    """Each stage's decisions against brute force on the stage before, with clashing columns, null and repeated ids."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    extra = spark.createDataFrame([
        (None, sentence(1, 50), "en", "s", 1), (7000, sentence(1, 50), "en", "s", 1), (7001, bench[0][1], "en", None, 1), (7001, sentence(2, 50), "en", "s", 1), (7002, "12 34", "en", "s", 1), (7003, None, "en", "s", 1),
    ], docs.schema)
    docs = docs.union(extra).withColumns({"size": F.lit("s"), "Score": F.lit(1), "lang_pred": F.lit(2), "kept": F.lit(True), "copies": F.lit(5)})
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = materialise(stage(spark, docs, SMALL), name)
        seen[name] = (before, docs)
        assert name == "token_output" or docs.columns == columns
    after = {n: [(r.doc_id, r.text) for r in seen[n][1].collect()] for n in list(seen)[:4]}
    assert {7002, 7003}.isdisjoint(d for d, _ in after["language_id"]) and len(after["language_id"]) >= 0.95 * len(seen["language_id"][0])
    rows = seen["near_dedup"][0]
    want, _ = groups(rows)
    assert Counter(d for d, _ in after["near_dedup"]) == Counter(d for (d, _), low in zip(rows, want, strict=True) if d == low and d is not None) - Counter(
        {d: n - 1 for d, n in Counter(d for (d, _), low in zip(rows, want, strict=True) if d == low).items() if n > 1 and d not in (7001,)}
    )
    texts = dict(seen["decontaminate"][0])
    leaks = weighted_leaks({d: t.lower().split() for d, t in texts.items() if d != 7001}, {i: t.lower().split() for i, t in bench})
    assert {d for d, _ in after["decontaminate"]} - {7001} == set(texts) - {d for d, _ in leaks} - {7001}
    assert (7001, sentence(2, 50)) in after["decontaminate"] and all(t != bench[0][1] for _, t in after["decontaminate"])
    copies = Counter(d for d, _ in after["mixing"])
    assert set(copies) <= {d for d, _ in after["decontaminate"]} and max(copies.values()) <= 3
    out = seen["token_output"][1].collect()
    assert len(out) == len(after["mixing"]) and sum(r.n_tokens for r in out) == max(r.start + r.n_tokens for r in out)


def test_near_dedup_stage_shuffles_texts_once_and_leaves_small_tables(spark):
    """Rows of one id and text, null ids among them, are merged to their least row; the stage's plan deals texts by one
    exchange, and of the tables on the way only those stay that its result reads."""
    kind = "doc_id long, text string, source string, size int"
    near = sentence(1).split()
    near[30] = "CHANGED"
    rows = [(5, sentence(1), s, n) for s, n in (("b", 1), ("a", 9), ("a", 2), (None, 3))] + [(6, " ".join(near), "a", 0), (0, sentence(2), "z", 1), (None, sentence(2), "a", 1)]
    rows += [(None, sentence(3), "b", 2), (None, sentence(3), "b", 1), (5, sentence(4), "c", 1), (7, " ", "d", 1), (7, " ", "d", 1), (None, None, "e", 1)]
    folder = Path(scratch(spark).removeprefix("file:"))
    before = set(folder.glob("*"))
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, kind).repartition(3), "")
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.glob("*")) - before}
    want = [(5, sentence(1), None, 3), (0, sentence(2), "z", 1), (None, sentence(3), "b", 1), (5, sentence(4), "c", 1), (7, " ", "d", 1), (7, " ", "d", 1), (None, None, "e", 1)]
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert left == {"signatures", "known", "labels"}
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    told = corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), "")._jdf.queryExecution().explainString(mode)
    dealt = re.findall(r"^\(\d+\) Exchange\nInput \[\d+\]: (.*)", told, re.M)
    assert dealt and sum(bool(re.search(r"\btext#|valueWithExtremumOrdering#|_row#", x)) for x in dealt) == 1


def test_workers_stay_small(spark, tmp_path):
    """A worker's arrays while it encodes distinct words, and the batches of the pipeline's first stage."""
    encode = token_output._encoder(queries.tokenizer_path())
    known = next(c.cell_contents for c in encode.__closure__ if isinstance(c.cell_contents, token_output.Pretokens))
    known.clear()
    for part in range(3):
        encode([" ".join(f"{i:x}".translate(str.maketrans("0123456789", "ghijklmnop")) for i in range(part * 300_000, part * 300_000 + 300_000))])
    assert len(known.keys) < 700_000 and len(known.at) == len(known.keys)
    known.clear()
    rows = [(i, "the quick brown fox and words of a text " * 50, "en", "s", 7) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.keep_known_languages(spark, docs, "")
    assert kept.inputFiles() and sorted(map(tuple, kept.collect())) == rows
    text_twice = language_id.identify(docs, language_id.learn(docs, F.lit(True)))._jdf.queryExecution().analyzed().toString()
    assert "AS _text" not in text_twice


def test_templates_hold_on_all_pages(spark):
    """What nineteen pages share and the twentieth doesn't is no template, whichever page that is; pages in any order
    and in any partitions give the same wrapper."""
    def page(i, odd):
        return f"<html><article><h1>Title {i}</h1><p>Story {i} of words and more words</p></article><div><p>x{i}</p></div>".replace("</article>", f"<blockquote>{'Its own words' if odd else 'Shared words'}</blockquote><h2>Always</h2></article>")

    rows = [(20 * k + i, f"http://h{k}.org/{i}", page(i, i == k)) for k in range(20) for i in range(20)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n") for r in html_extract.extract(frame).collect()}
    assert all(len(x) == 3 and x[2] == ("Its own words" if i // 20 == i % 20 else "Shared words") for i, x in got.items())
    told = {html_extract.expression(html_extract.infer([h for _, _, h in rows[:20]][k:] + [h for _, _, h in rows[:20]][:k])) for k in range(20)}
    survey = html_extract.surveyed(frame.filter("page_id < 20").repartition(7).withColumn("host", F.lit("h0.org")))
    assert told == {html_extract.wrappers(survey).first().wrapper}
