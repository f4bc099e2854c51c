"""Rules beyond the former caps: a thousand rules, and twelve tokens of a page."""

from tallyforge.llm.url_filter import mined


def test_tokens_that_always_occur_together_do_not_crowd_out_other_rules(spark):
    hot = [f"t{i:02}" for i in range(14)]
    rows = [(hot, True)] * 60 + [(["rare", "x"], True)] * 20 + [(["rare"], False)] * 2 + [(["x"], False)] * 40
    got = {t: (round(s * 122), round(c, 6)) for t, s, c in mined(spark.createDataFrame(rows, "tokens array<string>, block boolean"), 0.03, 0.8)}
    assert got == {(t,): (60, 1.0) for t in hot} | {("rare",): (20, round(20 / 22, 6)), ("rare", "x"): (20, 1.0)}


def test_rules_of_the_commonest_tokens_of_long_lists(spark):
    long = [f"m{j:02}" for j in range(14)]
    rows = [(long + ["a", "b"], True)] * 20 + [(long[:7], False)] * 20 + [(long[7:], False)] * 20 + [(["a"], False)] * 100 + [(["b"], False)] * 100
    got = {t: round(c, 6) for t, _, c in mined(spark.createDataFrame(rows, "tokens array<string>, block boolean"), 0.03, 0.8)}
    assert got[("a", "b")] == 1.0
