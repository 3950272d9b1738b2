import hashlib
import re

from pyspark.sql import functions as F

from promptloom.llm import exact_dedup

from .conftest import EDGE


def brute(rows):
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append(((-len(r[1] or ""), r[0] is None, r[0] or 0, i), r[0]))
    out = []
    for norm, members in groups.items():
        keep = min(members)
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(m[1], keep[1], len(members), sha) for m in members]
    return sorted(out, key=str)


def test_edge_rows(edge, empty):
    got = exact_dedup.exact_dedup(edge).collect()
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=str) == brute(EDGE)
    assert sum(r["kept"] for r in got) == len({r["text_sha256"] for r in got})
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_the_longest_then_smallest_stays(docs):
    got = exact_dedup.exact_dedup(docs((3, "a b"), (2, "ab"), (1, "a  b "), (0, "a b  "))).collect()
    assert {r["keep_id"] for r in got} == {0} and [r["doc_id"] for r in got if r["kept"]] == [0]


def test_colliding_identifiers_are_made_anew(docs):
    calls = []

    def weak(chunk, salt):
        calls.append(salt)
        return F.array(F.length(chunk).cast("long")) if salt == 0 else exact_dedup.identifier(chunk, salt)

    got = exact_dedup.exact_dedup(docs((1, "abcd"), (2, "abce"), (3, "a bcd")), make_id=weak).collect()
    assert {r["doc_id"]: r["group_size"] for r in got} == {1: 2, 2: 1, 3: 2} and 1 in calls


def test_chunks_join_to_the_text_and_survive_an_insertion(spark):
    body = "".join(f"word{i % 97}x{i * i % 89} the quick dog" for i in range(2000))
    df = spark.createDataFrame([(body,), (body[:5000] + "INSERTED" + body[5000:],)], "t string").select(exact_dedup.chunks(exact_dedup.normalized(F.col("t"))).alias("c"))
    a, b = (r["c"] for r in df.collect())
    assert "".join(a) == body.replace(" ", "") and max(map(len, a)) <= 1024
    assert len(set(a) & set(b)) > 0.5 * len(set(a))


def test_hot_group(docs):
    got = exact_dedup.exact_dedup(docs(*[(i, "hot text" if i % 2 else f"text {i}") for i in range(400)])).collect()
    assert len(got) == 400 and sum(r["kept"] for r in got) == 201 and {r["group_size"] for r in got} == {1, 200}


def test_kept_documents(edge):
    out = exact_dedup.kept_documents(edge)
    assert out.columns == edge.columns and out.count() == len({x[3] for x in brute(EDGE)})
