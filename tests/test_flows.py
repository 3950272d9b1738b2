import json
import os

import pytest
from pyspark.sql import functions as F

from promptloom.operators import extract
from promptloom.plans import flows
from promptloom.providers import Generation, GenerationConfig, Verifier, first_loaded, resolved
from promptloom.sources import files, sinks


def absent():
    raise ImportError("not here")


def test_first_model_that_loads():
    assert first_loaded([absent, lambda: "second", lambda: 1 / 0]) == "second"
    assert first_loaded([absent], missing="pass") is None
    with pytest.raises(RuntimeError):
        first_loaded([absent, absent])
    with pytest.raises(ZeroDivisionError):
        first_loaded([lambda: 1 / 0, lambda: "never"], missing="pass")


def test_settings_of_providers():
    config, key = resolved(GenerationConfig("openai"), {"OPENAI_API_KEY": "k"})
    assert config.model and key == "k"
    assert resolved(GenerationConfig("together", model="own"), {})[0].model == "own" and resolved(GenerationConfig("together"), {})[1] is None
    with pytest.raises(ValueError):
        resolved(GenerationConfig("unheard of"), {})


def test_verifier_without_inference_lets_that_gate_pass(spark):
    rows = spark.createDataFrame([(1, "you should say so now", "you should say so now."), (2, "you should say so now", "green is a colour"), (3, None, "a"), (4, "do not go there", "do go there")], "k int, a string, b string")
    got = {r["k"]: r["failed_gate"] for r in Verifier(inference=None).failed_gates(rows, "a", "b").collect()}
    assert got[1] is None and got[2] == "cosine" and got[4] in ("cosine", "negation") and len(got) == 4
    strict = Verifier(inference=lambda p, h: F.struct(F.lit(0.1).alias("entailment")))
    assert {r["k"]: r["failed_gate"] for r in strict.failed_gates(rows, "a", "b").collect()}[1] == "entailment"


def test_batch_keeps_phrases_whose_request_failed(spark):
    def ask(prompt):
        if "bad" in prompt:
            raise RuntimeError
        return "1. first variant\n2. second variant"

    rows = spark.createDataFrame([(1, "a good one"), (2, "a bad one")], "k int, text string")
    got = {r["k"]: r["variants"] for r in Generation(ask, retries=1).batch(rows, "k", "text").collect()}
    assert got == {1: ["first variant", "second variant"], 2: []}


def test_phrase_report(spark):
    rows = spark.createDataFrame([(2, 0, "be kind", 2), (1, 0, "say what is so", 4), (1, 1, "be brief", 2)], "prompt_id int, ord int, phrase string, word_count int")
    got = [r["value"] for r in sinks.phrase_report(rows).orderBy("section", "major", "minor").collect()]
    assert got == [
        '"say what is so" | 4 words | prompt_1', '"be brief" | 2 words | prompt_1', '"be kind" | 2 words | prompt_2', "Total unique phrases: 3", "  2 words: 2 phrases", "  4 words: 1 phrases",
        "  Short (2-3 words): 2", "  Medium (4-7 words): 1", "  Long (8+ words): 0",
    ]


def test_paraphrase_totals_without_variants(spark):
    none = spark.createDataFrame([], "phrase string, similarity double")
    got = [r["value"] for r in sinks.paraphrase_totals(spark.createDataFrame([("a",)], "phrase string"), none).orderBy("ord").collect()]
    assert got == ["  Total original phrases: 1", "  Phrases with variants: 0", "  Total variants generated: 0"]


@pytest.fixture
def phrase_file(tmp_path):
    path = tmp_path / "phrases.txt"
    path.write_text("\n".join(f'"{p}" | {len(p.split())} words | prompt_{i}' for i, p in enumerate(["you should say so when unsure", "you should say so if unsure", "you must avoid advice", "you should say so when not sure", "say so when unsure", "you should avoid legal advice", "say so if not sure of it", "always answer each question just as it is written and clearly mention every single source that was used"])))
    return str(path)


def test_paraphrase_commands(spark, phrase_file, tmp_path):
    for method in ("neighbours", "edits"):
        out = str(tmp_path / method)
        flows.main(["paraphrase", "--phrases", phrase_file, "--output", out, "--method", method])
        made = spark.read.parquet(f"{out}/variants").collect()
        back = files.paraphrases(files.whole(spark, f"{out}/blocks")).collect()
        assert made and sorted((r["phrase"], r["variant_no"], r["variant"]) for r in made) == sorted((r["phrase"], r["variant_no"], r["variant"]) for r in back)
        assert all(r["phrase"] != r["variant"] for r in made)


def said(prompt):
    phrase = prompt.split('Phrase: "', 1)[1][:-1]
    return f"1. {phrase} please\n2. {phrase}\n3. wholly other words"


def test_generate_command(spark, phrase_file, tmp_path):
    out = str(tmp_path / "made")
    phrases = files.phrases_strict(files.whole(spark, phrase_file))
    made = flows.generated_paraphrases(phrases, Generation(said, config=GenerationConfig(greatest_similarity=0.99)))
    flows.write_paraphrases(phrases, made, out)
    got = [json.loads(r["value"]) for r in files.whole(spark, f"{out}/json").selectExpr("explode(split(trim(value), '\\n')) as value").filter("value <> ''").collect()]
    assert sorted(p for x in got for v in x["paraphrases"].values() for p in v["paraphrases"]) == sorted(f"{r['phrase']} please" for r in phrases.collect())


def test_sample_command(spark, tmp_path):
    rows = [(i, f"text number {i % 7} " + "word " * (20 if i % 7 < 5 else 1)) for i in range(40)]
    spark.createDataFrame(rows, "at int, text string").repartition(3).write.parquet(str(tmp_path / "rows"))
    flows.main(["sample", "--rows", str(tmp_path / "rows"), "--order", "at", "--target", "4", "--budget", "30", "--output", str(tmp_path / "out")])
    got = spark.read.text(str(tmp_path / "out")).filter("value like 'text number%'").collect()
    assert sorted(r["value"].split()[2] for r in got) == ["0", "1", "2", "3"]


def test_corpus_and_user_commands(spark, tmp_path):
    tables = {
        "canonical": [{"ord": 0, "text": "You are A, one."}], "base": [{"ord": 0, "name": "B", "identity": "two", "personality": "calm", "behaviors": "Help.", "constraints": "Stop."}],
        "templates": [{"kind": "style", "ord": 0, "template": "{name}!"}], "extended": [{"ord": 0, "text": "x"}, {"ord": 1, "text": "y"}],
    }
    for name, rows in tables.items():
        (tmp_path / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))
    flows.main(["corpus", "--count", "6", "--output", str(tmp_path / "out"), *(x for n in tables for x in (f"--{n}", str(tmp_path / f"{n}.json")))])
    files_made = [f for f in os.listdir(tmp_path / "out") if f.startswith("part")]
    body = "".join((tmp_path / "out" / f).read_text() for f in sorted(files_made))
    got = [p.split("\n", 1)[1].strip() for p in body.split("=" * 80) if p.strip() for p in [p.strip()]]
    assert got == ["You are A, one.", "You are B, two. You are calm. Help. Stop.", "B!", "x", "y", "x"]
    (tmp_path / "users.json").write_text(json.dumps({"prompts_by_category": {"a": ["one two", "three"], "b": ["four"]}}))
    flows.main(["users", "--input", str(tmp_path / "users.json"), "--output", str(tmp_path / "users")])
    assert spark.read.json(str(tmp_path / "users" / "check")).first()["total"] == 3
    assert files.user_prompts(files.whole(spark, str(tmp_path / "users" / "prompts"))).count() == 3


def test_prefix_and_stamp(spark):
    got = spark.range(1).select(extract.strip_prefix(F.lit("You are are kind")).alias("a"), sinks.stamp(F.lit("2024-01-02 03:04:05").cast("timestamp")).alias("b"), sinks.stamp().alias("c")).first()
    assert got["a"] == "kind" and got["b"] == "2024-01-02 03:04:05" and len(got["c"]) == 19
