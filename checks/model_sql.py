"""Odds ratios in DuckDB: Newton's method written out step by step, Gauss-Jordan by list functions.

Ten slots of terms; a model leaves the ones it doesn't use at zero, with a one on their diagonal.
"""

from __future__ import annotations

from checks.study_sql import _SLICES, FOLLOW_UP, MODEL_EVENTS, study
from cohortide.operators.models import variable_columns

_SLOTS = ("one", "value", "age", "spline", "male", "months", "mid", "old", "mid_male", "old_male")
_N = len(_SLOTS)
_STEPS = 10
_Z = "1.959963984540054"
_WALD_5 = "11.070497693516351"  # 95 % point of chi-square with five degrees of freedom
_S = "study_id, outcome_id, slice"


def _cube(knot: str) -> str:
    return f"pow(greatest(age - {knot}, 0), 3)"


def _spline(k: str) -> str:
    k1, k2, k3 = (f"{k}[{i}]" for i in (1, 2, 3))
    return (
        f"(({_cube(k1)} - {_cube(k2)} * ({k3} - {k1}) / ({k3} - {k2}) + {_cube(k3)} * ({k2} - {k1}) / ({k3} - {k2}))"
        f" / pow({k3} - {k1}, 2))"
    )


def _row(terms: dict[str, str], when: dict[str, str] | None = None) -> tuple[str, str]:
    """Lists of the slots' values and of which are used; ``when`` makes a term conditional."""
    when = when or {}
    values, used = [], []
    for slot in _SLOTS:
        if slot not in terms:
            values.append("0.0::DOUBLE")
            used.append("false")
        elif slot in when:
            values.append(f"CASE WHEN {when[slot]} THEN ({terms[slot]})::DOUBLE ELSE 0.0 END")
            used.append(f"({when[slot]})")
        else:
            values.append(f"({terms[slot]})::DOUBLE")
            used.append("true")
    return f"[{', '.join(values)}]", f"[{', '.join(used)}]"


def _newton(p: str, features: str) -> list[tuple[str, str]]:
    """CTEs that fit every model of ``features`` (mk, x, used, n, y); the last one, ``{p}_fit``, has mk, beta, cov (rows
    of the inverse), ll, n, y and ok."""
    out = [
        (f"{p}_f", f"SELECT mk, x, used, sum(n)::DOUBLE AS n, sum(y)::DOUBLE AS y FROM ({features}) GROUP BY 1, 2, 3"),
        (
            f"{p}_b0",
            f"SELECT mk, any_value(used) AS used, sum(n) AS n, sum(y) AS y, "
            f"[ln(sum(y) / (sum(n) - sum(y))), {', '.join(['0.0::DOUBLE'] * (_N - 1))}] AS beta, 1.0::DOUBLE AS moved "
            f"FROM {p}_f GROUP BY 1 HAVING sum(y) > 0 AND sum(y) < sum(n)",
        ),
    ]
    eta = " + ".join(f"b.beta[{i}] * x[{i}]" for i in range(1, _N + 1))
    score = ", ".join(f"sum(x[{i}] * (y - n * q))" for i in range(1, _N + 1))
    rows = []
    for i in range(1, _N + 1):
        info = [
            f"sum(x[{i}] * x[{j}] * n * q * (1 - q))" + (f" + any_value(CASE WHEN used[{i}] THEN 0 ELSE 1 END)" if i == j else "")
            for j in range(1, _N + 1)
        ]
        unit = [f"{float(i == j)}::DOUBLE" for j in range(1, _N + 1)]
        rows.append(f"[{', '.join([*info, f'sum(x[{i}] * (y - n * q))', *unit])}]")
    for step in range(_STEPS):
        prev, now = f"{p}_b{step}", f"{p}_b{step + 1}"
        out.append(
            (
                f"{p}_s{step}",
                f"SELECT mk, sum(y * ln(q) + (n - y) * ln(1 - q)) AS ll, [{', '.join(rows)}] AS m FROM "
                f"(SELECT f.*, 1 / (1 + exp(-greatest(-30, least(30, {eta})))) AS q FROM {p}_f f JOIN {prev} b USING (mk)) GROUP BY 1",
            )
        )
        last = f"{p}_s{step}"
        for i in range(1, _N + 1):
            out.append(
                (
                    f"{p}_g{step}_{i}",
                    "SELECT mk, ll, list_transform(m, lambda row, j: CASE WHEN j = {i} THEN piv ELSE "
                    "list_transform(row, lambda v, c: v - row[{i}] * piv[c]) END) AS m FROM "
                    "(SELECT *, list_transform(m[{i}], lambda v: v / m[{i}][{i}]) AS piv FROM {last})".format(i=i, last=last),
                )
            )
            last = f"{p}_g{step}_{i}"
        moved = f"list_max(list_transform(range(1, {_N + 1}), lambda i: abs(g.m[i][{_N + 1}])))"
        out.append(
            (
                now,
                f"SELECT mk, b.used, b.n, b.y, list_transform(b.beta, lambda v, i: v + g.m[i][{_N + 1}]) AS beta, "
                f"{moved} AS moved, g.m AS m, g.ll AS ll FROM {prev} b JOIN {last} g USING (mk)",
            )
        )
    out.append(
        (
            f"{p}_fit",
            f"SELECT mk, beta, list_transform(m, lambda row: row[{_N + 2}:]) AS cov, ll, n, y, "
            f"coalesce(moved < 1e-6 AND list_max(list_transform(beta, lambda v: abs(v))) < 25, false) AS ok "
            f"FROM {p}_b{_STEPS}",
        )
    )
    return out


_AGE = "(age - 65) / 10.0"
_MALE = "CASE gender WHEN 'Male' THEN 1 ELSE 0 END"
_MID, _OLD = "CASE WHEN age BETWEEN 45 AND 64 THEN 1 ELSE 0 END", "CASE WHEN age >= 65 THEN 1 ELSE 0 END"


def _select(name: str, source: str, terms: dict[str, str], where: str = "true", when: dict[str, str] | None = None) -> str:
    x, used = _row({"one": "1", **terms}, when)
    key = f"{{'s': study_id, 'o': outcome_id, 'c': slice, 'name': {name}}}"
    return f"SELECT {key} AS mk, {x} AS x, {used} AS used, n, y FROM {source} WHERE {where}"


def _key(side: str, name: str) -> str:
    return f"{side}.mk.s = d.study_id AND {side}.mk.o = d.outcome_id AND {side}.mk.c = d.slice AND {side}.mk.name = {name}"


def odds_ratios() -> str:
    """Every row of the odds ratios, on the log scale."""
    crossed = {"mid": _MID, "old": _OLD, "male": _MALE, "mid_male": f"({_MID}) * ({_MALE})", "old_male": f"({_OLD}) * ({_MALE})"}
    first = [
        _select("'linear'", "people", {"age": _AGE}),
        _select("'spline'", "people JOIN knots USING (study_id, outcome_id, slice)", {"age": _AGE, "spline": _spline("k")}, "good"),
        _select("'crossed'", "people", crossed),
    ]
    variables = " UNION ALL ".join(
        f"SELECT {_S}, '{var}' AS var, {column} AS value, gender, age, months_since_start AS months, ev FROM big"
        for var, column in variable_columns().items()
    )
    at = [_SLOTS.index(t) + 1 for t in ("mid", "old", "male", "mid_male", "old_male")]
    # Wald test: the inverse of the covariance's 5 x 5 block, by the same elimination on its own rows
    block = ", ".join(
        "[" + ", ".join([*(f"cov[{i}][{j}]" for j in at), f"beta[{i}]"]) + "]" for i in at
    )
    wald, last = [("w_0", f"SELECT mk, beta, [{block}] AS m FROM one_fit WHERE mk.name = 'crossed' AND ok")], "w_0"
    for i in range(1, 6):
        wald.append(
            (
                f"w_{i}",
                "SELECT mk, beta, list_transform(m, lambda row, j: CASE WHEN j = {i} THEN piv ELSE "
                "list_transform(row, lambda v, c: v - row[{i}] * piv[c]) END) AS m FROM "
                "(SELECT *, list_transform(m[{i}], lambda v: v / m[{i}][{i}]) AS piv FROM {last})".format(i=i, last=last),
            )
        )
        last = f"w_{i}"
    chi = " + ".join(f"beta[{slot}] * m[{i}][6]" for i, slot in enumerate(at, 1))
    bic = "-2 * {f}.ll + {p} * ln({f}.n)"
    decide = (
        f"SELECT d.*, coalesce(s.ok AND l.ok AND {bic.format(f='s', p=3)} < {bic.format(f='l', p=2)}, false) AS curved, "
        f"coalesce(w.chi > {_WALD_5}, false) AS by_sex, l.ok AS l_ok, l.beta AS l_beta, l.cov AS l_cov, s.beta AS s_beta, s.cov AS s_cov "
        f"FROM heads d JOIN one_fit l ON {_key('l', chr(39) + 'linear' + chr(39))} "
        f"LEFT JOIN one_fit s ON {_key('s', chr(39) + 'spline' + chr(39))} "
        f"LEFT JOIN (SELECT mk, {chi} AS chi FROM w_5) w ON {_key('w', chr(39) + 'crossed' + chr(39))}"
    )
    aged = {"age": _AGE, "spline": _spline("k")}
    bent = {"spline": "curved"}
    known = f"{{source}} JOIN decided USING ({_S})"
    second = [
        _select("'sex'", "people", {"male": _MALE}),
        _select("'sex by age'", known.format(source="people"), {"male": _MALE, **aged}, when=bent),
        *(
            _select(
                f"'age {sex}'",
                f"(SELECT p.*, d.curved AND q.good AS bent, d.by_sex, q.k AS k FROM people p JOIN decided d USING ({_S}) "
                f"JOIN knots_by_sex q ON q.study_id = p.study_id AND q.outcome_id = p.outcome_id AND q.slice = p.slice AND q.gender = '{sex}')",
                aged,
                f"by_sex AND gender = '{sex}'",
                {"spline": "bent"},
            )
            for sex in ("Male", "Female")
        ),
        _select("var || '|Unadjusted'", "expo", {"value": "value"}, "finite"),
        _select(
            "var || '|Adjusted for age and sex'", known.format(source="expo"), {"value": "value", **aged, "male": _MALE}, "finite", bent
        ),
        _select(
            "var || '|Adjusted for age, sex, and calendar time'",
            known.format(source="expo"),
            {"value": "value", **aged, "male": _MALE, "months": "months"},
            "finite AND months IS NOT NULL",
            bent,
        ),
    ]
    ages = "(VALUES " + ", ".join(f"({a})" for a in range(20, 91, 5)) + ") v(rel_age)"

    def at_age(k: str) -> str:
        return f"({_spline(k).replace('age -', 'rel_age -')} - {_spline(k).replace('age -', '65 -')})"

    slot = {t: i for i, t in enumerate(_SLOTS, 1)}
    a, s = slot["age"], slot["spline"]

    def bounds(value: str, se: str, ok: str) -> str:
        return ", ".join(
            f"round(CASE WHEN {ok} THEN {v} END, 5) + 0.0 AS {name}"
            for name, v in (("log_or", value), ("log_low", f"{value} - {_Z} * {se}"), ("log_high", f"{value} + {_Z} * {se}"))
        )

    curve = (
        f"SELECT {_S}, n_tot, n_w_outcome, sex, rel_age, ok, ca * beta[{a}] + cs * beta[{s}] AS value, "
        f"sqrt(greatest(ca * ca * cov[{a}][{a}] + 2 * ca * cs * cov[{a}][{s}] + cs * cs * cov[{s}][{s}], 0)) AS se FROM ("
        f"SELECT d.{_S.replace(', ', ', d.')}, d.n_tot, d.n_w_outcome, g.sex, v.rel_age, (v.rel_age - 65) / 10.0 AS ca, "
        f"CASE WHEN NOT d.by_sex AND d.curved THEN {at_age('d.k')} "
        f"WHEN d.by_sex AND d.curved AND q.good THEN {at_age('q.k')} ELSE 0 END AS cs, "
        "CASE WHEN d.by_sex THEN t.ok WHEN d.curved THEN true ELSE d.l_ok END AS ok, "
        "CASE WHEN d.by_sex THEN t.beta WHEN d.curved THEN d.s_beta ELSE d.l_beta END AS beta, "
        "CASE WHEN d.by_sex THEN t.cov WHEN d.curved THEN d.s_cov ELSE d.l_cov END AS cov "
        f"FROM decided d CROSS JOIN (VALUES ('Male'), ('Female')) g(sex) CROSS JOIN {ages} "
        "LEFT JOIN knots_by_sex q ON q.study_id = d.study_id AND q.outcome_id = d.outcome_id AND q.slice = d.slice AND q.gender = g.sex "
        f"LEFT JOIN two_fit t ON {_key('t', chr(39) + 'age ' + chr(39) + ' || g.sex')})"
    )
    none = "CAST(NULL AS INTEGER) AS ref_age, CAST(NULL AS INTEGER) AS rel_age"
    m, v = slot["male"], slot["value"]
    sexes = " UNION ALL ".join(
        f"SELECT d.{_S.replace(', ', ', d.')}, 'Sex (Male:Female)' AS var, '{label}' AS model, NULL::VARCHAR AS gender, d.n_tot, d.n_w_outcome, "
        f"{bounds(f't.beta[{m}]', f'sqrt(t.cov[{m}][{m}])', 't.ok')}, {none} FROM decided d LEFT JOIN two_fit t ON "
        + _key("t", f"'{name}'")
        for name, label in (("sex", "Unadjusted"), ("sex by age", "Adjusted for age"))
    )
    forms = "(VALUES ('Unadjusted'), ('Adjusted for age and sex'), ('Adjusted for age, sex, and calendar time')) f(model)"
    exposures = (
        f"SELECT d.{_S.replace(', ', ', d.')}, d.var, f.model, NULL::VARCHAR AS gender, NULL::BIGINT AS n_tot, NULL::BIGINT AS n_w_outcome, "
        f"{bounds(f't.beta[{v}]', f'sqrt(t.cov[{v}][{v}])', 't.ok')}, {none} "
        f"FROM (SELECT DISTINCT {_S}, var, dated FROM expo) d CROSS JOIN {forms} "
        f"LEFT JOIN two_fit t ON {_key('t', 'd.var || ' + chr(39) + '|' + chr(39) + ' || f.model')} "
        "WHERE d.dated OR NOT contains(f.model, 'calendar')"
    )
    parts = [
        *FOLLOW_UP,
        ("sliced", _SLICES),
        ("busy", f"SELECT {_S} FROM sliced GROUP BY {_S} HAVING sum(ev) >= {MODEL_EVENTS}"),
        ("big", f"SELECT s.* FROM sliced s JOIN busy USING ({_S})"),
        ("people", f"SELECT {_S}, gender, age, count(*) AS n, sum(ev) AS y FROM big GROUP BY {_S}, gender, age"),
        ("heads", "SELECT h.*, k.k, k.good FROM "
         f"(SELECT {_S}, sum(n)::BIGINT AS n_tot, sum(y)::BIGINT AS n_w_outcome FROM people GROUP BY {_S}) h JOIN knots k USING ({_S})"),
        ("long", f"SELECT {_S}, var, value, gender, age, months, count(*) AS n, sum(ev) AS y FROM ({variables}) GROUP BY ALL"),
        (
            "expo",
            f"SELECT * FROM (SELECT *, sum(n) FILTER (value = 1) OVER w AS n1, coalesce(sum(y) FILTER (value = 1) OVER w, 0) AS y1, "
            "sum(n) OVER w AS n0, sum(y) OVER w AS y0, bool_or(months IS NOT NULL) OVER w AS dated, "
            "y1 > 0 AND y1 < n1 AND y1 < y0 AND n1 - y1 < n0 - y0 AS finite FROM long "
            f"WINDOW w AS (PARTITION BY {_S}, var)) WHERE n1 > 5",
        ),
    ]
    parts.insert(-3, ("knots", f"SELECT {_S}, k, k[1] < k[2] AND k[2] < k[3] AS good FROM "
                      f"(SELECT {_S}, quantile_cont(age::DOUBLE, [0.1, 0.5, 0.9]) AS k FROM big GROUP BY {_S})"))
    parts.insert(-3, ("knots_by_sex", f"SELECT {_S}, gender, k, k[1] < k[2] AND k[2] < k[3] AS good FROM "
                      f"(SELECT {_S}, gender, quantile_cont(age::DOUBLE, [0.1, 0.5, 0.9]) AS k FROM big GROUP BY {_S}, gender)"))
    parts += [
        *_newton("one", " UNION ALL ".join(first)),
        *wald,
        ("decided", decide),
        *_newton("two", " UNION ALL ".join(second)),
        ("curves_by_age", curve),
    ]
    final = (
        f"SELECT {_S}, 'Age' AS var, NULL::VARCHAR AS model, sex AS gender, n_tot, n_w_outcome, {bounds('value', 'se', 'ok')}, "
        f"65 AS ref_age, rel_age FROM curves_by_age UNION ALL {sexes} UNION ALL {exposures}"
    )
    return study(parts, final)
