import pytest
from pyspark.sql import functions as F

from discursa.functions import annotation as an
from discursa.operators import annotate, scoring


def records(spark, responses):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(responses)], "i int, r string")
    rows = df.select("i", an.label_record(an.salvage_json(F.col("r"))).alias("l")).orderBy("i").collect()
    return [None if r.l is None else tuple(r.l) for r in rows]


def answer(spam="false", stance="unclear", emotion="grief"):
    return f'{{"spam": {spam}, "stance": "{stance}", "emotion": "{emotion}"}}'


def test_validation(spark):
    cases = {
        answer(): (False, "unclear", "grief"),
        f"```json\n{answer()}\n```": (False, "unclear", "grief"),
        "no json here": None,
        answer(emotion="griefxyz"): (False, "unclear", "grief"),
        answer(emotion="gri"): (False, "unclear", "grief"),
        answer(stance="criticises_ judiciary"): (False, "criticises_judiciary", "grief"),
        answer(stance="SUPPORTS_SUBJECT"): (False, "supports_subject", "grief"),
        answer(stance="criticises"): None,
        answer(stance=""): None,
        answer(stance="anger"): None,
        answer(spam="true", stance="supports_subject"): (True, "unclear", "neutral"),
        answer(spam='"false"'): (True, "unclear", "neutral"),
        answer(spam='""'): (False, "unclear", "grief"),
        answer(spam="0"): (False, "unclear", "grief"),
        answer(spam="2.5"): (True, "unclear", "neutral"),
        answer(spam="null"): (False, "unclear", "grief"),
        answer(spam="[]"): (False, "unclear", "grief"),
        answer(spam="[0]"): (True, "unclear", "neutral"),
        '{"stance": "unclear", "emotion": "grief"}': None,
        "[1, 2]": None,
        '{"spam": false, "stance": 5, "emotion": "grief"}': None,
    }
    assert dict(zip(cases, records(spark, list(cases)))) == cases


def test_annotate_with_failing_model(spark):
    def make():
        def ask(messages):
            text = messages[-1]["content"]
            if text == "boom":
                raise TimeoutError
            return answer() if text == "fine" else "???"

        return ask

    work = spark.createDataFrame(
        [("p#2", "k", "f1", 1, t) for t in ("fine", "boom", "odd", "fine")],
        "id string, cluster string, phase string, likes bigint, clean string",
    )
    done = annotate.annotate(work, make)
    assert [tuple(r) for r in annotate.label_yield(done).collect()] == [(2, 2, 0.5)]
    rows = annotate.labelled(done).collect()
    assert len(rows) == 2 and rows[0].post == "p" and rows[0].spam == 0


def test_prompt_cuts_text_and_keeps_examples(spark):
    df = spark.createDataFrame([("x" * 2000,)], "t string")
    messages = df.select(an.prompt(F.col("t"), "sys", [("shown", {"a": 1})], max_chars=1500)).collect()[0][0]
    assert [m.role for m in messages] == ["system", "user", "assistant", "user"]
    assert messages[2].content == '{"a": 1}' and len(messages[3].content) == 1500
    assert len(df.select(an.prompt(F.col("t"))).collect()[0][0][-1].content) == 2000


def test_scoring_replaces_blank_text_and_applies_rules(spark):
    def load():
        def model(texts):
            assert all(texts)
            return {
                "spam": [[0.0, 5.0 if "slot" in t else -5.0] for t in texts],
                "stance": [[3.0, 0, 0, 0, 0, 0] for _ in texts],
                "emotion": [[0.1, 0, 0, 0, 0] for _ in texts],
            }

        return model

    rows = spark.createDataFrame(
        [("a", "slot", False, ""), ("b", "😭", True, "😭"), ("c", "hello", False, ""), ("d", "", False, "")],
        "id string, clean string, emoji_only boolean, emoji string",
    )
    out = scoring.score_corpus(rows, load, {"stance": 2.0}, {"spam": 0.5, "stance": 0.5, "emotion": 0.3})
    got = {r.id: (r.spam, r.stance, r.emotion) for r in out.collect()}
    assert got == {
        "a": (True, "unclear", "anger"), "b": (False, "unclear", "grief"),
        "c": (False, "supports_subject", "anger"), "d": (False, "supports_subject", "anger"),
    }
    conf = out.where("id = 'c'").collect()[0]
    assert abs(conf.stance_conf - 2.718281828 ** 1.5 / (2.718281828 ** 1.5 + 5)) < 1e-6 and conf.stance_abstain


def test_faults_of_the_program_end_the_job(spark):
    from pyspark.sql import functions as F

    from discursa.operators import annotate

    def failing(error):
        def make():
            def ask(messages):
                raise error
            return ask
        return make

    df = spark.range(3).select(F.array(F.struct(F.lit("user").alias("role"), F.lit("x").alias("content"))).alias("p"))
    for error in (TimeoutError(), ConnectionResetError(), KeyError("choices")):
        assert {r[0] for r in df.select(annotate.complete(F.col("p"), failing(error))).collect()} == {None}
    with pytest.raises(Exception, match="ZeroDivisionError|PythonException|PYTHON"):
        df.select(annotate.complete(F.col("p"), failing(ZeroDivisionError()))).collect()


def test_few_prompts_are_objects_at_once(spark):
    """A batch of Arrow rows may be large: only ASKED prompts of it become messages at a time."""

    def make():
        import gc

        def ask(messages):
            if messages[-1]["content"] not in ("x0", "x3000"):
                return "y"
            return str(sum(type(o) is dict and o.keys() == {"role", "content"} for o in gc.get_objects()))

        return ask

    df = spark.range(0, 4000, 1, 1).select(F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("x"), "id").alias("content"))).alias("p"))
    answers = [r[0] for r in df.select(annotate.complete(F.col("p"), make)).collect()]
    assert len(answers) == 4000 and answers.count("y") == 3998
    assert max(int(answers[0]), int(answers[3000])) <= 2 * annotate.ASKED + 2 * annotate.CONCURRENCY
