"""Templates as columns, against the text they should give."""

import pytest

from tessera.operators.templates import rendered

S = "name string, n int, ok boolean, tags array<string>, docs array<struct<title:string,score:int,refs:array<string>>>"
ROWS = [("Ann <b>", 3, True, ["x", "y"], [("T1", 5, ["r1", "r2"]), ("T2", 0, []), ("T3", 2, None)]), (None, 0, None, [], []), ("", None, False, None, None)]


def shown(spark, template, **kw):
    df = spark.createDataFrame(ROWS, S).coalesce(1)
    return [r[0] for r in df.select(rendered(df, template, **kw)).collect()]


@pytest.mark.parametrize("template,want", [
    ("Hi {{ name }}!", ["Hi Ann <b>!", "Hi !", "Hi !"]),
    ("{% if n > 2 and ok %}big{% elif n == 0 %}none{% else %}?{% endif %}", ["big", "none", "?"]),
    ("{% for t in tags %}{{ loop.index }}{{ t }}{% if not loop.last %}, {% endif %}{% endfor %}.", ["1x, 2y.", ".", "."]),
    ("{% if docs %}Docs:\n{% for d in docs %}\n  {% if d.score %}\n- {{ d.title }} ({{ d.score }}){% for r in d.refs %} {{ r | upper }}{% endfor %}\n\n  {% endif %}\n{% endfor %}\n{% endif %}end", ["Docs:\n- T1 (5) R1 R2\n- T3 (2)\nend", "end", "end"]),
    ("{{ tags | length }}|{{ name | default('nobody') }}|{{ tags | join('+') }}|{{ ok }}", ["2|Ann <b>|x+y|True", "0|nobody||", "0|||False"]),
    ("{# note #}{{ docs[0].title }}{{ tags[5] }}{% if 'x' in tags %} in{% endif %}{% if name is none %} none{% endif %}", ["T1 in", " none", ""]),
    ("{% if not (n or ok) %}{{ 'a' }}{% endif %}{{ 1.5 }}", ["1.5", "a1.5", "a1.5"]),
    ("", ["", "", ""]), ("plain % { }", ["plain % { }"] * 3),
])
def test_templates(spark, template, want):
    assert shown(spark, template) == want


def test_escape_and_values_that_look_like_tags(spark):
    assert shown(spark, "{{ name }}", escape=True)[0] == "Ann &lt;b&gt;"
    df = spark.createDataFrame([("{{ n }}{% if x %}",)], "name string")
    assert df.select(rendered(df, "<{{ name }}>")).first()[0] == "<{{ n }}{% if x %}>"


@pytest.mark.parametrize("template", ["{{ nobody }}", "{% for x in n %}{% endfor %}", "{% if n %}", "{% for d in docs %}{{ d.nothing }}{% endfor %}", "{{ n | nothing }}", "{% while n %}", "{{ n + 1 }}", "{% endif %}", "{{ n n }}"])
def test_mistakes_are_told_before_anything_runs(spark, template):
    df = spark.createDataFrame(ROWS, S)
    with pytest.raises(ValueError):
        rendered(df, template)
