"""The literal text rules, quirks included."""

import pytest
from pyspark.sql import functions as F

from lodeglass.functions import text as tx
from lodeglass.operators import replies
from lodeglass.operators.replies import MANUAL_GUIDANCE, MANUAL_TASK, NO_RESPONSE


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()]


def tasks(spark, text):
    df = spark.createDataFrame([(1, text)], "key int, g string")
    return [r["task"] for r in replies.task_blocks(df, "key", "g").orderBy("pos").collect()]


def sections(spark, text):
    df = spark.createDataFrame([(1, text)], "key int, r string")
    return replies.response_sections(df, "key", "r").first().asDict()


@pytest.mark.parametrize("text", [None, ""])
def test_no_guidance_no_tasks(spark, text):
    assert tasks(spark, text) == []


def test_blank_guidance_has_no_sentinel(spark):
    assert tasks(spark, " \n\t ") == [MANUAL_GUIDANCE]


def test_guidance_without_headers_is_one_block(spark):
    assert tasks(spark, "  - Task 1: a\n## Task 2: b\n ") == ["- Task 1: a\n## Task 2: b", MANUAL_TASK]


@pytest.mark.parametrize(
    "header", ["**Task 1:**", "Task 1:", "Task 1.:", "**Task 1: a**", "  task1:", "TASK 2:", "Task ١:"]
)
def test_headers_that_count(spark, header):
    assert tasks(spark, f"intro\n{header} one\nmore\n\nTask 2: two") == [
        f"{header.strip()} one\nmore",
        "Task 2: two",
        MANUAL_TASK,
    ]


@pytest.mark.parametrize("header", ["## Task 1:", "- Task 1:", "Task one:", "Task 1", "A Task 1:"])
def test_headers_that_do_not_count(spark, header):
    assert tasks(spark, f"{header} one\nTask 2: two") == ["Task 2: two", MANUAL_TASK]


def test_stop_line_ends_everything(spark):
    text = "Task 1: a\nTask 2: b\nand 5. Develop Narrative: c\nTask 3: d"
    assert tasks(spark, text) == ["Task 1: a", "Task 2: b", MANUAL_TASK]


def test_only_a_stop_line_keeps_the_whole_text(spark):
    assert tasks(spark, "words\n5. Develop Narrative: c\n") == ["words\n5. Develop Narrative: c", MANUAL_TASK]


def test_repeats_go_and_the_sentinel_stays_last(spark):
    assert tasks(spark, "Task 1: a\nTask 2: b\nTask 1: a\n") == ["Task 1: a", "Task 2: b", MANUAL_TASK]
    assert tasks(spark, MANUAL_TASK) == [MANUAL_TASK]


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", " "])
def test_every_line_end_starts_a_line(spark, end):
    text = f"x{end}Task 1: a{end}b{end}Task 2: c{end}5. Develop Narrative:"
    assert tasks(spark, text) == [f"Task 1: a{end}b", "Task 2: c", MANUAL_TASK]


@pytest.mark.parametrize("text", [None, ""])
def test_no_reply(spark, text):
    assert sections(spark, text) == {
        "key": 1,
        "approach": NO_RESPONSE,
        "code": "",
        "results_text": "",
        "insights": "",
    }


def test_reply_with_all_sections(spark):
    text = (
        "Hello\n1. **Approach:** Look.\n\n2.  **Python Code:**\n```python\nprint(1)\n```\n"
        "**Results:** One.**\n4. **Key Insights:**\n- a\n- b\n"
    )
    assert sections(spark, text) == {
        "key": 1,
        "approach": "Look.",
        "code": "print(1)",
        "results_text": "One.",
        "insights": "- a\n- b",
    }


def test_bare_code_and_insights_are_no_headers(spark):
    got = sections(spark, "Approach: a\nCode: b\nInsights: c")
    assert got["approach"] == "a\nCode: b\nInsights: c"
    assert got["code"] == "Could not parse 'code' section."
    assert got["insights"] == "Could not parse 'insights' section."


def test_optional_last_letter(spark):
    got = sections(spark, "pytho code: x\nke insights: y\nPYTHONCODE: z")
    assert (got["code"], got["insights"]) == ("z", "y")


def test_last_repeated_header_wins_even_when_empty(spark):
    assert sections(spark, "Results: a\nResults: b")["results_text"] == "b"
    assert sections(spark, "Results: a\nResults:")["results_text"] == ""


def test_header_inside_a_line_does_not_count(spark):
    assert sections(spark, "Results: the approach: fine")["results_text"] == "the approach: fine"


def test_stray_bold_is_trimmed_once_per_side(spark):
    # The header's own closing asterisks are the one leading pair that goes.
    assert sections(spark, "**Approach:**\n** bold ** \n")["approach"] == "** bold"
    assert sections(spark, "Approach: ** bold ** \n")["approach"] == "bold"


def test_strip_takes_all_whitespace(spark):
    space = "\t\n\x0b\x0c\r\x1c\x1f \x85    　"
    assert column(spark, [space + "a b" + space, space, None], tx.strip) == ["a b", "", None]


def test_snippet_cuts_by_code_point(spark):
    got = column(spark, ["abc", "abcd", "\U0001f600é漢x", None, ""], lambda c: tx.snippet(c, 3))
    assert got == ["abc", "abc...", "\U0001f600é漢...", None, ""]


def test_escape_braces(spark):
    assert column(spark, ["{a}", "{{", "x", None], tx.escape_braces) == ["{{a}}", "{{{{", "x", None]


def test_code_screen(spark):
    got = column(spark, ["os.system('x')", "import subprocess", "os .system", None], tx.code_allowed)
    assert got == [False, False, True, None]


def test_usable_response(spark):
    got = column(spark, ["fine", "", None, "Error: x", "error: x", " Error:"], tx.usable_response)
    assert got == [True, False, False, False, True, True]


@pytest.mark.parametrize(
    "name, ext",
    [
        ("a.CSV", ".csv"),
        ("a", ""),
        (".bashrc", ""),
        ("..x", ""),
        ("a.b.c", ".c"),
        ("dir.d/file", ""),
        ("dir.d/.hid", ""),
        ("a.", "."),
        ("..a.b", ".b"),
        ("x/y.tar.GZ", ".gz"),
    ],
)
def test_extension_of(spark, name, ext):
    assert column(spark, [name], tx.extension_of) == [ext]


def test_missing_labels(spark):
    df = spark.createDataFrame([(None, "", "x"), ("a", "b", "c")], "a string, b string, c string")
    got = df.select(tx.missing_labels({"A": F.col("a"), "B": F.col("b"), "C": F.col("c")}).alias("m")).collect()
    assert [r["m"] for r in got] == ["A, B", ""]


def test_fill_template_does_not_rescan_values(spark):
    df = spark.createDataFrame([("{b}", "{{x}}")], "a string, b string")
    filled = tx.fill_template("{a}|{{a}}|{b}", {"a": F.col("a"), "b": F.col("b")})
    assert df.select(filled.alias("p")).first()["p"] == "{b}|{a}|{{x}}"


def test_fill_template_missing_key(spark):
    with pytest.raises(KeyError):
        tx.fill_template("{nobody}", {})


def test_distinct_in_order(spark):
    df = spark.createDataFrame([(["b", "z", "a", "b"],), (["a"],), ([],)], "v array<string>")
    got = df.select(replies.distinct_in_order(F.col("v"), "z").alias("o")).collect()
    assert [r["o"] for r in got] == [["b", "a", "z"], ["a"], []]
