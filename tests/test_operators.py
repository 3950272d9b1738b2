import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from promptloom.operators import corpus, edits, extract, importance, ranking, similarity
from promptloom.plans.flows import phrase_importance
from promptloom.providers import CountingProvider, Generation, TableProvider, hashed_embedding
from promptloom.sources import files, sinks


def test_rules_are_sixty_five_and_compile():
    rules = extract.rule_table()
    assert len(rules) == 65 and [n for _, n, _ in rules] == list(range(65))


def test_contains_join_finds_what_a_nested_loop_finds(spark):
    prompts = spark.createDataFrame([(1, "You are kind and patient, be fair."), (2, "xbe fair"), (3, "")], "prompt_id int, text string")
    phrases = spark.createDataFrame([(0, "be fair"), (1, "are kind and patient"), (2, "ind and pat"), (3, "Kind"), (4, "kind and")], "ord int, phrase string")
    got = {(r["prompt_id"], r["ord"]) for r in importance.phrases_in_prompts(prompts, phrases).collect()}
    assert got == {(1, 0), (2, 0), (1, 1), (1, 2), (1, 4)}


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 12), st.integers(0, 8)), max_size=15))
def test_containment_equals_the_greedy_loop(spark, spans):
    rows = [(g, a, a + n, i) for i, (g, a, n) in enumerate(spans)]
    kept = []
    for r in sorted(rows, key=lambda r: (r[1] - r[2], r[3])):
        if not any(k[0] == r[0] and k[1] <= r[1] and k[2] >= r[2] for k in kept):
            kept.append(r)
    df = spark.createDataFrame(rows, "g int, start int, `end` int, ord int")
    assert sorted(map(tuple, extract.drop_contained(df, "g").collect())) == sorted(kept)


def test_greedy_jaccard_is_not_transitive(spark):
    rows = [(1, 0, ["a", "b", "c", "d"]), (1, 1, ["b", "c", "d"]), (1, 2, ["c", "d"]), (1, 3, [])]
    df = spark.createDataFrame(rows, "g int, ord int, t array<string>")
    kept = extract.greedy_distinct(df, "g", [-F.size("t"), F.col("ord")], "t", 0.6)
    assert sorted(r["ord"] for r in kept.collect()) == [0, 2, 3]


def test_extraction_end_to_end(spark):
    prompts = spark.createDataFrame([(1, "You are Ada, an AI assistant created by Acme. You should provide clear answers to every question. ")], "prompt_id int, text string")
    all_phrases = [r["phrase"] for r in extract.extract(prompts).orderBy("ord").collect()]
    assert all_phrases[0] == "Ada, an AI assistant created by Acme" and "provide clear answers to every question" in all_phrases
    distinct = {r["phrase"] for r in extract.extract_distinct(prompts).collect()}
    assert distinct <= set(all_phrases) and len(distinct) == 2


def test_ties_go_to_the_first(spark):
    rows = spark.createDataFrame([("p", "x", 1, 0.5), ("p", "y", 2, 0.5), ("q", "x", 1, 0.1)], "g string, phrase string, ord int, s double")
    assert {(r["g"], r["phrase"]) for r in ranking.best_of_group(rows, "g", "s", "ord").collect()} == {("p", "x"), ("q", "x")}
    assert [(r["phrase"], r["frequency"]) for r in ranking.frequency(rows, "phrase", "g", "ord", 5).orderBy("place").collect()] == [("x", 2), ("y", 1)]


def test_prompt_scans(spark, tmp_path):
    bar = "=" * 80
    body = f"Prompt 1:\nFirst prompt text that is long.\n\n{bar}\n\nPrompt 7:\nLine one of seven is here\nline two\n\n{bar}\n\nPrompt 40:\nToo late but long enough to keep\n\n{bar}\n"
    path = str(tmp_path / "p.txt")
    open(path, "w").write(body)
    whole = files.whole(spark, path)
    assert [(r[0], r[1]) for r in files.prompts_scored(whole).orderBy("prompt_id").collect()] == [(1, "First prompt text that is long."), (7, "Line one of seven is here\nline two")]
    assert [r[0] for r in files.prompts_labelled(whole).orderBy("prompt_id").collect()] == [1, 7, 40]
    assert [r[0] for r in files.prompts_positional(whole).orderBy("prompt_id").collect()] == [1, 2, 3]
    assert files.prompts_flattened(whole).filter("prompt_id = 2").first()["text"] == "Line one of seven is here line two"


def test_phrase_scans(spark, tmp_path):
    path = str(tmp_path / "c.txt")
    open(path, "w").write('Format: phrase | words | prompt\n----\n"one two three" | 3 words | prompt_2\n"a | b c" | 3 words | prompt_1\n')
    whole = files.whole(spark, path)
    assert [(r["phrase"], r["prompt_id"]) for r in files.phrases_strict(whole).orderBy("ord").collect()] == [("one two three", 2), ("a | b c", 1)]
    assert [r["phrase"] for r in files.phrases_prefixed(whole).orderBy("ord").collect()] == ["one two three", "a | b c"]
    assert files.phrases_loose(whole).count() == 2 and files.phrases_loose(whole, strict=False).count() == 3
    assert files.phrases_quoted(whole).count() == 2


def test_paraphrase_scan_round_trip(spark, tmp_path):
    path = str(tmp_path / "v.txt")
    open(path, "w").write('1. ORIGINAL: "be kind"\n    1. "be \\1 nice"\n    2. "be good" (similarity: 0.900)\n2. ORIGINAL: no quotes\n    3. "still kind"\n3. ORIGINAL: "be kind"\n    1. "new"\n4. ORIGINAL: "x y"\n    1. "z"\n')
    got = [tuple(r) for r in files.paraphrases(files.whole(spark, path)).orderBy("phrase", "variant_no").collect()]
    assert got == [("be kind", 1, "new", None), ("x y", 1, "z", None)]
    blocks = sinks.paraphrase_blocks(files.paraphrases(files.whole(spark, path)))
    out = str(tmp_path / "out")
    blocks.coalesce(1).write.text(out)
    assert files.paraphrases(files.whole(spark, out)).count() == 2


@pytest.mark.parametrize("body, want", [
    ('["a", "b"]', ["a", "b"]), ('{"all_prompts": ["a"], "prompts_by_category": {"x": ["b"]}}', ["a"]),
    ('{"prompts_by_category": {"x": ["b"], "y": ["c"]}}', ["b", "c"]), ('{"x": ["b"], "n": 3}', ["b"]),
])
def test_user_prompt_shapes(spark, tmp_path, body, want):
    path = str(tmp_path / "u.json")
    open(path, "w").write(body)
    assert [r["text"] for r in files.user_prompts(files.whole(spark, path)).orderBy("ord").collect()] == want


def test_user_prompts_reject_other_json(spark, tmp_path):
    path = str(tmp_path / "u.json")
    open(path, "w").write("3")
    with pytest.raises(Exception, match="neither a list nor an object"):
        files.user_prompts(files.whole(spark, path)).collect()


def flow(spark, provider_of):
    prompts = spark.createDataFrame([(1, "be kind to all and help the user")], "prompt_id int, text string")
    phrases = spark.createDataFrame([(0, "be kind"), (1, "help the user"), (2, "absent words")], "ord int, phrase string")
    variants = spark.createDataFrame([("be kind", 1, "be cold"), ("help the user", 1, "help the user")], "phrase_key string, variant_no int, variant string")
    users = spark.createDataFrame([(0, "hello")], "user_no int, user string")
    return phrase_importance(prompts, phrases, variants, users, provider_of(prompts))


def test_importance_flow(spark, tmp_path):
    said = spark.createDataFrame([("hello", 0, "kind words"), ("hello", 1, "kind user")], "user string, sample_no int, text string")
    ranked = flow(spark, lambda prompts: CountingProvider(said, said.select("text"))).orderBy("rank").collect()
    assert [(r["phrase"], r["rank"]) for r in ranked] == [("be kind", 1), ("help the user", 2)]
    assert ranked[0]["kl_score"] > 0 and ranked[1]["kl_score"] == 0.0


def test_reports(spark, tmp_path):
    ranked = spark.createDataFrame([(1, 1, "a b", 0.5), (1, 2, "c d", 0.1), (2, 1, "a b", 0.7)], "prompt_id int, rank int, phrase string, kl_score double")
    path = str(tmp_path / "r")
    sinks.checkpoint_results(ranked, path)
    prompts = spark.createDataFrame([(1, "p"), (2, "q"), (3, "r")], "prompt_id int, text string")
    assert [r[0] for r in sinks.unfinished(prompts, spark, path).collect()] == [3]
    assert sinks.summary(ranked).filter("prompt_id = 1").first()["num_phrases"] == 2
    overall = sinks.overall_summary(ranked).first()
    assert [x["phrase"] for x in overall["top_phrases_per_prompt"]] == ["a b", "a b"] and overall["most_common_phrases"][0]["frequency"] == 2
    assert [r["label"] for r in sinks.chart(ranked).orderBy("place").collect()] == ["a b", "a b"]
    assert sinks.prompt_report(ranked, prompts).count() == 2


def test_similar_pairs_in_chunks(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(30, 8))
    emb = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i in range(30) for j in range(i + 1, 30) if u[i] @ u[j] >= 0.2}
    assert {(r["a"], r["b"]) for r in similarity.similar_pairs(emb, 0.2, 1.0, chunk=7).collect()} == want


def test_average_linkage_against_a_plain_loop():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(20, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    groups = [[i] for i in range(20)]
    while len(groups) > 1:
        s, a, b = max((np.mean([v[i] @ v[j] for i in x for j in y]), -m, -n) for m, x in enumerate(groups) for n, y in enumerate(groups) if m < n)
        if s < 0.3:
            break
        groups[-a] += groups.pop(-b)
    label = similarity.average_linkage(v, 0.3)
    assert {frozenset(np.flatnonzero(label == k).tolist()) for k in set(label.tolist())} == {frozenset(g) for g in groups}


def test_diverse_subset_modes(spark):
    emb = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])], "id long, vec array<double>")
    far = [r["id"] for r in similarity.diverse_subset(emb, 2).orderBy("ord").collect()]
    near = [r["id"] for r in similarity.diverse_subset(emb, 2, "closest").orderBy("ord").collect()]
    assert far[0] == near[0] and far != near


def test_edits(spark):
    rows = spark.createDataFrame([(1, "You should say so when unsure; whenever")], "k int, text string")
    got = [r["variant"] for r in edits.minimal_edits(rows).orderBy("ord").collect()]
    assert "please say so when unsure; whenever" in got and "You should say so if unsure; whenever" in got
    staged = edits.staged_edits(rows, "k", k=3).orderBy("ord").collect()
    assert len(staged) == 3 and staged[0]["variant"] == "You should state that when unsure; whenever"


def test_levels_with_and_without_repeats(spark):
    rows = spark.createDataFrame([(1, "a", 0.96, 0.0, 0.9), (1, "b", 0.91, 0.0, 0.8)], "k int, c string, cosine double, contradiction double, entailment double")
    assert [(r["c"], r["level"]) for r in edits.first_passing_level(rows, "k", "c").orderBy("place").collect()] == [("a", 1), ("b", 3)]
    assert [(r["c"], r["level"]) for r in edits.first_passing_level(rows, "k", "c", dedupe=False).orderBy("place").collect()] == [("a", 1), ("a", 2), ("a", 3)]


def test_tools_filter(spark):
    texts = ["tool only", "{\"a\"}", "json then tool", "Json tool", "Tools: [x]", "tool:{"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(corpus.mentions_tools(F.col("t"))).collect()] == [False, False, True, False, True, True]


def test_renumber_and_cycle(spark):
    rows = spark.createDataFrame([(x, f"t{x}") for x in (5, 3, 9)], "pos int, text string")
    assert [(r["pos"], r["number"]) for r in corpus.renumber(rows, "pos").orderBy("pos").collect()] == [(3, 1), (5, 2), (9, 3)]
    numbered = corpus.renumber(rows, "pos").select("text", (F.col("number") - 1).alias("number"))
    assert [r["text"] for r in corpus.cyclic(numbered, spark, 5).orderBy("place").collect()] == ["t3", "t5", "t9", "t3", "t5"]


def test_assembly(spark):
    def table(*texts):
        return spark.createDataFrame(list(enumerate(texts)), "ord int, text string")

    templates = spark.createDataFrame([("polarity", 0, "You are {name}, polite.")], "kind string, ord int, template string")
    got = [r["text"] for r in corpus.assemble(spark, table("c"), table("You are Ada, x.", "no name"), templates, table("e1", "e2"), 8).orderBy("place").collect()]
    assert got == ["c", "You are Ada, x.", "no name", "You are Ada, polite.", "You are Assistant, polite.", "e1", "e2", "e1"]


def test_providers(spark):
    rows = spark.createDataFrame([(1, "be kind", "say it")], "k int, text string, prompt string")
    made = Generation(lambda p: "1. be very nice\n2. be kind").paraphrases(rows, "k", "text").collect()
    assert [r["variant"] for r in made] == ["be very nice", "be kind"][:1]

    def fail(p):
        raise OSError

    assert Generation(fail, retries=1).paraphrases(rows, "k", "text").count() == 0
    vec = hashed_embedding(rows, "k", "text", 16).first()["vec"]
    assert len(vec) == 16 and sum(x * x for x in vec) == pytest.approx(1)
    table = TableProvider(spark.createDataFrame([("a", 0)], "cache_key string, sample_no int"), rows)
    assert table.sample(spark.createDataFrame([("a",)], "cache_key string")).count() == 1


def test_top_up_asks_for_keys_without_variants_and_counts_distinct_ones(spark):
    from promptloom.providers import top_up

    asked = []

    def more(short):
        got = {r["k"]: r["have"] for r in short.collect()}
        asked.append(got)
        return spark.createDataFrame([(k, i, f"{k} new {len(asked)} {i}") for k in got for i in range(1)], "k string, ord int, variant string")

    first = spark.createDataFrame([("a", 0, "x"), ("a", 1, "X"), ("b", 0, "p"), ("b", 1, "q")], "k string, ord int, variant string")
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    got = sorted((r["k"], r["place"], r["variant"]) for r in top_up(keys, first, more, "k", 2).collect())
    assert asked[0] == {"a": 1, "c": 0} and asked[1] == {"c": 1}
    assert got == [("a", 1, "x"), ("a", 2, "a new 1 0"), ("b", 1, "p"), ("b", 2, "q"), ("c", 1, "c new 1 0"), ("c", 2, "c new 2 0")]
