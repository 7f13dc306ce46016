"""Sources: normalised tokens, tree profiles, dead code, repair and named algorithms."""

import ast

from gradeloom.operators import source as S


def test_renaming_and_comments_do_not_change_tokens():
    a, b = S.normalised_tokens("x = 1  # note\nprint(x)\n"), S.normalised_tokens("value = 22\nprint(value)\n")
    assert a == b == ["v0", "=", "NUM", "print", "(", "v0", ")"]


def test_broken_sources_still_have_tokens():
    assert S.normalised_tokens("def f(:\n  return 'a\n")[:2] == ["def", "v0"]


def test_profiles_of_a_leaf_and_of_a_renamed_copy():
    assert S.tree_profile("") == ["Module/*/*/*"]
    assert S.tree_profile(S.SAMPLE[0]) == S.tree_profile(S.SAMPLE[1]) != S.tree_profile(S.SAMPLE[3])
    assert S.tree_profile("def f(:") is None


def test_unreached_functions_and_statements_go():
    live = S.live_source(S.SAMPLE[5])
    assert "pad" not in live and "helper" in live and "x = 1" not in live
    assert S.live_source("def f(:") == "def f(:"


def test_repair_finds_the_smallest_edit():
    for broken, kind in [("def f(x)\n    return x\n", "insert_colon"), ("def f(x):\nreturn x\n", "fix_indent"), ("print((1)\n", "close_delimiter"), ("def f(x):\n    if x = 1:\n        return 2\n", "fix_comparison")]:
        text, edits = S.repaired(broken)
        ast.parse(text)
        assert len(edits) == 1 and edits[0].startswith(kind)
    assert S.repaired("x = 1\n") == ("x = 1\n", [])
    assert S.repaired("$ $ $\n" * 9) == (None, [])


def test_algorithms_need_a_word_of_the_name(spark):
    texts = [S.SAMPLE[0], "def f(xs):\n    while xs:\n        if xs: pass\n        if xs: pass\n", "def f(n, memo):\n    for i in n:\n        memo[i] = cache\n", "", "def lower(highest):\n    return 1\n"]
    got = {r.id: {x.algorithm: x.confidence for x in r.found} for r in S.algorithms(S.code_graph(spark.createDataFrame(list(enumerate(texts)), "id int, source string"))).collect()}
    assert got[0]["binary_search"] == 1.0 and list(got[0])[0] == "binary_search" and "hash_lookup" not in got[4]
    assert "binary_search" not in got[1] and got[1]["linear_scan"] == 1.0
    assert got[2]["dynamic_programming"] == 1.0 and got[3] == {} and len(got) == 5


def test_columns(spark):
    got = {r.id: r for r in S.queries()["e2_tree_similarity"](spark, "").collect()}
    assert got[0].similarity == got[1].similarity == 1.0 and got[2].similarity == 0.0 and 0 < got[3].similarity < 1
    assert {r.id: r.edits for r in S.queries()["e6_repair"](spark, "").collect()}[2] == ["insert_colon:1"]
    for name, q in S.queries().items():
        assert q(spark, "").count() >= 1, name
