"""Colour commands of formulas: folds over tokens against a plain recursive reading."""

import random
import re

from inkshard.functions import constants as K
from inkshard.functions import styles

_TEX_TOKEN = re.compile(r"\\[A-Za-z]+|\\.|[{}]|[^\\{}]+|\\$", re.DOTALL)
_MODEL = re.compile(r"\s*(?:\[([^\]]*)\]\s*)?")


def _resolved(model: str | None, value: str) -> str | None:
    digits = value.removeprefix("#")
    if (model or "").lower() not in ("", "html"):
        return None
    if re.fullmatch(r"[0-9A-Fa-f]{6}", digits):
        return digits.upper()
    if re.fullmatch(r"[0-9A-Fa-f]{3}", digits):
        return "".join(d * 2 for d in digits).upper()
    return None if model else K.MATH_COLORS.get(value.lower())


def _mark_colors(tex: str) -> str:
    tokens, closes, stack = _TEX_TOKEN.findall(tex), {}, []
    for i, t in enumerate(tokens):
        if t == "{":
            stack.append(i)
        elif t == "}" and stack:
            closes[stack.pop()] = i

    def gap(i: int, allow_model: bool) -> tuple[int, str | None] | None:
        """Step over white space, and a model in brackets, in front of a brace."""
        if i < len(tokens) and tokens[i][0] not in "\\{}":
            m = _MODEL.fullmatch(tokens[i])
            if m is None or (m[1] is not None and not allow_model):
                return None
            return i + 1, m[1]
        return i, None

    def render(lo: int, hi: int) -> str:
        out, i = [], lo
        while i < hi:
            step = colored(i) if tokens[i] in ("\\color", "\\textcolor") else None
            text, i = step if step else (tokens[i], i + 1)
            out.append(text)
        return "".join(out)

    def colored(i: int) -> tuple[str, int] | None:
        before = gap(i + 1, True)
        if before is None or before[0] not in closes:
            return None
        color_end = closes[before[0]]
        between = gap(color_end + 1, False)
        if between is None or between[0] not in closes:
            return None
        end = closes[between[0]]
        color = _resolved((before[1] or "").strip(), "".join(tokens[before[0] + 1 : color_end]).strip())
        inner = render(between[0] + 1, end)
        if color:
            inner = "\\text{@@PMC:" + color + "@@}" + inner + "\\text{@@PMCEND@@}"
        return inner, end + 1

    return render(0, len(tokens))


def test_random_formulas(spark):
    rng = random.Random(21)
    bits = ["\\color", "\\textcolor", "{", "{", "}", "}", "{red}", "{#0f0}", "{00ff00}", "{x}", "[HTML]", " [html] ", "[rgb]", " ", "a", "\\}", "\\{", "\\frac", "\\colorbox", "\n", "\\", "", "[", "]", "nocolor"]
    cases = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 24))) for _ in range(3000)]
    cases += ["", "\\color", "\\textcolor{red}{a", "\\color{red}{" * 400 + "x" + "}" * 400]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string").repartition(8)
    got = dict(df.select("i", styles.math_color_tokens("t")).collect())
    plain = {i: _mark_colors(c) for i, c in enumerate(cases[:-1])}
    assert [(cases[i], got[i], w) for i, w in plain.items() if got[i] != w] == []
    assert sum(w != cases[i] for i, w in plain.items()) > 100
    assert got[len(cases) - 1] == "\\text{@@PMC:FF0000@@}" * 400 + "x" + "\\text{@@PMCEND@@}" * 400


def test_formulas_stay_in_the_jvm(spark):
    plan = spark.range(1).selectExpr("CAST(id AS STRING) AS t").select(styles.math_color_tokens("t"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
    df = spark.createDataFrame([(None,), ("\\color{red}{x}",)], "t string")
    assert [r[0] for r in df.select(styles.math_color_tokens("t")).collect()] == [None, "\\text{@@PMC:FF0000@@}x\\text{@@PMCEND@@}"]
