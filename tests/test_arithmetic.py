from corpusflow.operators.arithmetic import modular_examples, modular_grid


def test_grid_sizes(spark):
    assert modular_grid(spark, 5, "x+y").count() == 25
    assert modular_grid(spark, 5, "x/y").count() == 20
    assert modular_grid(spark, 2, "x-y").count() == 4
    assert modular_grid(spark, 97, "x/y").count() == 9312


def test_examples_semantics(spark):
    rows = modular_examples(spark, ["x+y", "x-y", "x/y"], [5]).collect()
    plus = {(r.x, r.y): r for r in rows if r.op == "x+y"}
    assert plus[(3, 4)].label == 7 and plus[(3, 4)].inputs == [3, 6, 4, 5]
    minus = {(r.x, r.y): r for r in rows if r.op == "x-y"}
    assert minus[(1, 3)].label == -2
    div = {(r.x, r.y): r for r in rows if r.op == "x/y"}
    assert div[(2, 3)].inputs == [1, 6, 3, 5] and div[(2, 3)].label == 2
    red = modular_examples(spark, ["x-y"], [5], reduce_labels=True).collect()
    assert {(r.x, r.y): r.label for r in red}[(1, 3)] == 3
