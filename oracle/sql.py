"""DuckDB statements for the registered queries.

Written apart from the Spark code on purpose: windows are matched by range joins,
islands by NOT EXISTS, resampling by cross joins - forms that would not scale but are
easy to read as definitions.
"""

from __future__ import annotations

from leakaudit.plans import fixture

# What is expected, written out apart from the code under test.
N_BOOT = 300
SWEEP = [6.0, 24.0, 72.0, 100.0, 144.0]
COPIES = [1, 2, 5, 15]
WORST = {"creatinine": "max", "bilirubin_total": "max", "platelets": "min", "pao2": "min", "fio2": "max"}
MEASURED = (
    "heart_rate sbp dbp mbp resp_rate spo2 temp_f gcs_eye gcs_verbal gcs_motor creatinine bilirubin_total platelets"
    " wbc lactate potassium sodium bun pao2 paco2 ph fio2"
).split()
STATE_FEATURES = (
    "heart_rate sbp dbp mbp resp_rate spo2 temp_f gcs_total creatinine potassium sodium bun bilirubin_total platelets"
    " wbc lactate ph pf_ratio sofa_resp sofa_coag sofa_liver sofa_renal sofa_cns sofa_cardio sofa_total"
).split()

I, W, H, N = 24.0, 144.0, 432, 18


def _values(rows) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        return f"'{v}'" if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


def r(expr: str, name: str | None = None) -> str:
    return f"ROUND({expr}, 6) + 0.0 AS {name or expr}"


def unit(purpose: str, *keys: str) -> str:
    parts = ", ".join(["'42'", f"'{purpose}'", *keys])
    return f"(('0x' || substr(md5(concat_ws('|', {parts})), 1, 13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE)"


def hashed(purpose: str, *keys: str) -> str:
    return f"md5(concat_ws('|', '42', '{purpose}', {', '.join(keys)}))"


_KIND = {**{f: "vital" for f in fixture.VITALS}, **{f: "lab" for f in fixture.LABS}, "fio2": "fio2"}
_ITEMS = _values((code, f, lo, hi, _KIND[f]) for code, (f, lo, hi) in fixture.READINGS.items())
_DRUGS = _values((code, d, fixture.RATE_DIVISORS[code]) for code, d in fixture.DRUGS.items())


def _score_case(value: str, op: str, limits) -> str:
    whens = " ".join(f"WHEN {value} {op} {limit} THEN {points}" for limit, points in limits)
    return f"CASE WHEN {value} IS NULL THEN NULL {whens} ELSE 0 END::INTEGER"


def _windowed(width: float) -> str:
    maxed = ", ".join(f"'{f}'" for f, s in WORST.items() if s == "max")
    mined = ", ".join(f"'{f}'" for f, s in WORST.items() if s == "min")
    return f"""
        SELECT l.stay_id, l.feature, g.bin,
               CASE WHEN l.feature IN ({maxed}) THEN max(l.value)
                    WHEN l.feature IN ({mined}) THEN min(l.value) ELSE avg(l.value) END AS value
        FROM long l JOIN bins g ON l.hours_from_admit >= g.t - {width} AND l.hours_from_admit < g.t
        GROUP BY l.stay_id, l.feature, g.bin"""


def _wide(source: str) -> str:
    columns = ", ".join(f"max(value) FILTER (WHERE feature = '{f}') AS {f}" for f in MEASURED)
    return f"SELECT stay_id, bin, {columns} FROM {source} GROUP BY stay_id, bin"


def _scores(wide: str, window: str) -> str:
    resp = _score_case("pf_ratio", "<", [(100, 4), (200, 3), (300, 2), (400, 1)])
    coag = _score_case("platelets", "<", [(20, 4), (50, 3), (100, 2), (150, 1)])
    liver = _score_case("bilirubin_total", ">=", [(12, 4), (6, 3), (2, 2), (1.2, 1)])
    renal = _score_case("creatinine", ">=", [(5, 4), (3.5, 3), (2, 2), (1.2, 1)])
    cns = _score_case("gcs_total", "<", [(6, 4), (10, 3), (13, 2), (15, 1)])
    return f"""
        SELECT *, greatest(cardio_score_from_map, cardio_score_from_dose) AS sofa_cardio,
               (coalesce(sofa_resp, 0) + coalesce(sofa_coag, 0) + coalesce(sofa_liver, 0)
                + coalesce(sofa_renal, 0) + coalesce(sofa_cns, 0)
                + greatest(cardio_score_from_map, cardio_score_from_dose))::INTEGER AS sofa_total,
               '{window}' AS "window"
        FROM (
          SELECT *, {resp} AS sofa_resp, {coag} AS sofa_coag, {liver} AS sofa_liver,
                 {renal} AS sofa_renal, {cns} AS sofa_cns,
                 (CASE WHEN mbp < 70 THEN 1 ELSE 0 END)::INTEGER AS cardio_score_from_map,
                 (CASE WHEN dopamine > 15 OR epi > 0.1 OR norepi > 0.1 THEN 4
                       WHEN dopamine > 5 OR (epi > 0 AND epi <= 0.1) OR (norepi > 0 AND norepi <= 0.1) THEN 3
                       WHEN (dopamine > 0 AND dopamine <= 5) OR dobutamine > 0 THEN 2
                       ELSE 0 END)::INTEGER AS cardio_score_from_dose
          FROM (
            SELECT w.*, d.dopamine, d.dobutamine, d.epi, d.norepi, w.pao2 / w.fio2 AS pf_ratio,
                   CASE WHEN w.gcs_eye IS NULL AND w.gcs_motor IS NULL THEN NULL
                        ELSE coalesce(w.gcs_eye, 4) + coalesce(w.gcs_verbal, 5) + coalesce(w.gcs_motor, 6)
                   END AS gcs_total
            FROM {wide} w LEFT JOIN doses d USING (stay_id, bin)))"""


def _covered(source: str, w: str, stays: str = "treated") -> str:
    piece = f"greatest(0.0, least(g.t, i.end_h) - greatest(g.t - {w}, i.start_h))"
    return f"""
        SELECT s.stay_id, g.bin, g.t,
               ROUND(coalesce(sum(CASE WHEN i.start_h < g.t THEN {piece} END), 0.0), 9) AS hours
        FROM {stays} s CROSS JOIN bins g LEFT JOIN {source} i ON i.stay_id = s.stay_id
        GROUP BY s.stay_id, g.bin, g.t"""


def _peak(drug: str) -> str:
    return f"""CASE WHEN count(*) FILTER (WHERE i.drug = '{drug}') > 0
                    THEN max(i.rate) FILTER (WHERE i.drug = '{drug}') ELSE 0.0 END AS {drug}"""


_OTHERS = ["sofa_resp", "sofa_coag", "sofa_liver", "sofa_renal", "sofa_cns"]

# name -> (tables it builds on, its body)
_CTES: dict[str, tuple[list[str], str]] = {
    "items": ([], f"""SELECT itemid, feature, lo::DOUBLE AS lo, hi::DOUBLE AS hi, kind
        FROM (VALUES {_ITEMS}) v(itemid, feature, lo, hi, kind)"""),
    "drugs": ([], f"SELECT itemid, drug, div::DOUBLE AS div FROM (VALUES {_DRUGS}) v(itemid, drug, div)"),
    "bins": ([], f"SELECT b::INTEGER AS bin, (b + 1) * {I}::DOUBLE AS t FROM range({N}) x(b)"),
    "stays": ([], """SELECT user_id AS stay_id, min(ts) AS intime, user_id + 500000 AS hadm_id
        FROM events GROUP BY user_id"""),
    "ev": ([], """SELECT *, regexp_extract(props, '"k": *([0-9]+)', 1)::INTEGER AS k FROM events"""),
    "coded": (["ev"], """SELECT *, (CASE event_type WHEN 'click' THEN 10 WHEN 'error' THEN 20
            WHEN 'signup' THEN 30 WHEN 'view' THEN 40 END + k % 6)::BIGINT AS itemid
        FROM ev WHERE event_type <> 'purchase'"""),
    "chart": (["coded", "items"], """SELECT c.user_id AS stay_id, c.itemid, c.ts AS charttime,
            (CASE WHEN i.feature LIKE 'gcs%'
                  THEN floor(i.lo + (i.hi - i.lo) * ((c.event_id * 7919 % 1000)::DOUBLE / 1000.0::DOUBLE))
                  ELSE i.lo + (i.hi - i.lo) * ((c.event_id * 7919 % 1000)::DOUBLE / 1000.0::DOUBLE) END) AS valuenum,
            (CASE WHEN k = 99 THEN 1 ELSE 0 END)::INTEGER AS warning, i.feature, i.kind
        FROM coded c LEFT JOIN items i USING (itemid)"""),
    "timed": (["chart", "stays"], """SELECT c.*, date_sub('hour', s.intime, c.charttime) AS whole_hours,
            date_sub('minute', s.intime, c.charttime)::DOUBLE / 60.0::DOUBLE AS hours
        FROM chart c JOIN stays s USING (stay_id)"""),
    "vitals": (["timed"], f"""SELECT stay_id, feature, floor(hours) AS hours_from_admit, avg(valuenum) AS value
        FROM timed WHERE kind = 'vital' AND valuenum > 0 AND warning = 0 AND whole_hours BETWEEN 0 AND {H}
        GROUP BY ALL"""),
    "labs": (["timed"], f"""SELECT stay_id, feature, floor(hours) AS hours_from_admit, avg(valuenum) AS value
        FROM timed WHERE kind = 'lab' AND valuenum IS NOT NULL AND whole_hours BETWEEN 0 AND {H}
        GROUP BY ALL"""),
    "fio2": (["timed"], f"""SELECT stay_id, feature, floor(hours) AS hours_from_admit,
            avg(valuenum / 100.0::DOUBLE) AS value
        FROM timed WHERE kind = 'fio2' AND valuenum BETWEEN 21 AND 100 AND whole_hours BETWEEN 0 AND {H}
        GROUP BY ALL"""),
    "long": (["vitals", "labs", "fio2"], """
        SELECT stay_id, CASE WHEN feature = 'mbp_arterial' THEN 'mbp' ELSE feature END AS feature,
               hours_from_admit, value FROM vitals
        UNION ALL SELECT * FROM labs UNION ALL SELECT * FROM fio2"""),
    "win_short": (["long", "bins"], _windowed(I)),
    "win_long": (["long", "bins"], _windowed(W)),
    "wide_short": (["win_short"], _wide("win_short")),
    "wide_long": (["win_long"], _wide("win_long")),
    "infus": (["ev"], """SELECT user_id AS stay_id, (50 + k % 6)::BIGINT AS itemid, ts AS starttime, k,
            CASE WHEN k % 33 <> 7 THEN ts + to_seconds(round(value * 1800)::BIGINT) END AS endtime, value AS amount,
            CASE WHEN k % 10 = 0 THEN 'mg/hr' WHEN k % 25 = 3 THEN NULL ELSE 'mcg/kg/min' END AS rateuom
        FROM ev WHERE event_type = 'purchase'"""),
    "raw_iv": (["infus", "drugs", "stays"], """SELECT f.stay_id, f.itemid, d.drug,
            date_sub('minute', s.intime, f.starttime)::DOUBLE / 60.0::DOUBLE AS start_h,
            date_sub('minute', s.intime, f.endtime)::DOUBLE / 60.0::DOUBLE AS end_h,
            f.k::DOUBLE / d.div AS rate, f.rateuom, f.amount
        FROM infus f JOIN stays s USING (stay_id) JOIN drugs d USING (itemid)
        WHERE f.endtime IS NOT NULL AND f.amount > 0"""),
    "iv": (["raw_iv"], """SELECT * FROM raw_iv
        WHERE drug IN ('phenylephrine', 'vasopressin') OR coalesce(rateuom, '') = 'mcg/kg/min'"""),
    "treated": (["iv"], "SELECT DISTINCT stay_id FROM iv"),
    "isl": (["iv"], """
        SELECT s.stay_id, s.start_h, min(e.end_h) AS end_h
        FROM (SELECT DISTINCT a.stay_id, a.start_h FROM iv a WHERE NOT EXISTS (
                SELECT 1 FROM iv b WHERE b.stay_id = a.stay_id AND b.start_h < a.start_h AND b.end_h >= a.start_h)) s
        JOIN (SELECT DISTINCT a.stay_id, a.end_h FROM iv a WHERE NOT EXISTS (
                SELECT 1 FROM iv b WHERE b.stay_id = a.stay_id AND b.start_h <= a.end_h AND b.end_h > a.end_h)) e
          ON e.stay_id = s.stay_id AND e.end_h >= s.start_h
        GROUP BY s.stay_id, s.start_h"""),
    "cov_short": (["isl", "treated", "bins"], _covered("isl", str(I))),
    "cov_long": (["isl", "treated", "bins"], _covered("isl", str(W))),
    "sum_long": (["iv", "treated", "bins"], _covered("iv", str(W))),
    "conds": (["cov_short", "cov_long"], f"""
        SELECT stay_id, bin, t, hours AS contaminated_hours, least(1.0, hours / {W}::DOUBLE) AS pct_of_window,
               'before_correction' AS window_condition FROM cov_long
        UNION ALL
        SELECT stay_id, bin, t, hours, least(1.0, hours / {I}::DOUBLE), 'after_correction' FROM cov_short"""),
    "doses": (["iv", "bins"], f"""
        SELECT s.stay_id, g.bin, {_peak('dopamine')}, {_peak('dobutamine')}, {_peak('epi')}, {_peak('norepi')}
        FROM (SELECT DISTINCT stay_id FROM iv WHERE drug IN ('dopamine', 'dobutamine', 'epi', 'norepi')) s
        CROSS JOIN bins g
        LEFT JOIN iv i ON i.stay_id = s.stay_id AND i.start_h < g.t AND i.end_h > g.t - {I}
        GROUP BY s.stay_id, g.bin"""),
    "act": (["iv", "stays", "bins"], f"""
        SELECT s.stay_id, g.bin, (EXISTS (SELECT 1 FROM iv i WHERE i.stay_id = s.stay_id
                 AND i.start_h < g.t AND i.end_h > g.t - {I}))::INTEGER AS action
        FROM stays s CROSS JOIN bins g"""),
    "lab_next": (["act"], """
        SELECT stay_id, bin, action_next FROM (
          SELECT stay_id, bin, lead(action) OVER (PARTITION BY stay_id ORDER BY bin) AS action_next FROM act)
        WHERE action_next IS NOT NULL"""),
    "sc_short": (["wide_short", "doses"], _scores("wide_short", "short")),
    "sc_long": (["wide_long", "doses"], _scores("wide_long", "long")),
    "exp1": (["sc_short", "sc_long"], """
        SELECT *, cardio_score_from_dose > cardio_score_from_map AS dose_determined,
               coalesce(dopamine > 0, false) OR coalesce(dobutamine > 0, false)
                 OR coalesce(epi > 0, false) OR coalesce(norepi > 0, false) AS treated
        FROM (SELECT * FROM sc_short UNION ALL SELECT * FROM sc_long)"""),
    "bare": (["sc_short", "lab_next"], "SELECT stay_id, bin, action_next, "
        + ", ".join(f"{f}::DOUBLE AS {f}" for f in STATE_FEATURES)
        + " FROM sc_short JOIN lab_next USING (stay_id, bin)"),
    "state": (["bare"], "SELECT stay_id, bin, action_next, "
        + ", ".join(f"coalesce({f}, (SELECT avg({f}) FROM bare)) AS {f}" for f in STATE_FEATURES)
        + " FROM bare"),
    "pred": (["lab_next", "cov_short"], f"""
        SELECT l.stay_id, l.bin, l.action_next AS y,
               ROUND(coalesce(least(1.0, c.hours / {I}::DOUBLE), 0.0), 9) AS score
        FROM lab_next l LEFT JOIN cov_short c USING (stay_id, bin)"""),
    "grp": (["pred"], f"""
        SELECT stay_id, row_number() OVER (ORDER BY {hashed('bootstrap_group', 'stay_id')}, stay_id) - 1 AS idx
        FROM (SELECT DISTINCT stay_id FROM pred)"""),
    "joined_labels": (["sc_short", "lab_next"], "SELECT * FROM sc_short JOIN lab_next USING (stay_id, bin)"),
}


def _weights(groups: str, n_boot: int) -> str:
    """Draws of every replicate, counted per group."""
    return f"""
        SELECT g.stay_id, d.rep, count(*) AS weight
        FROM (SELECT rep::INTEGER AS rep,
                     floor({unit('bootstrap_draw', 'rep', 'idx')} * (SELECT count(*) FROM {groups}))::BIGINT AS idx
              FROM {groups}, range({n_boot}) x(rep)) d
        JOIN {groups} g USING (idx) GROUP BY g.stay_id, d.rep"""


def _auc_by(cells: str, source: str) -> str:
    """Rank-sum AUROC from per-score totals of (cells, score, y, w)."""
    return f"""
        SELECT {cells}, sum(p * (below + n / 2.0::DOUBLE)) / (sum(p)::DOUBLE * sum(n)::DOUBLE) AS auroc
        FROM (SELECT {cells}, score, p, n, coalesce(sum(n) OVER (PARTITION BY {cells} ORDER BY score
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS below
              FROM (SELECT {cells}, score, sum(CASE WHEN y = 1 THEN w ELSE 0 END)::DOUBLE AS p,
                           sum(CASE WHEN y = 1 THEN 0 ELSE w END)::DOUBLE AS n
                    FROM {source} GROUP BY {cells}, score))
        GROUP BY {cells} HAVING sum(p) > 0 AND sum(n) > 0"""


def _pairs_auc(source: str) -> str:
    return f"""
        SELECT avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END::DOUBLE)
        FROM {source} a JOIN {source} b ON a.y = 1 AND b.y = 0"""


def _info(source: str, cells: str = "feature") -> str:
    """Mutual information from (cells, b, y, w)."""
    keys = [c.strip() for c in cells.split(",")]
    on = " AND ".join(f"x.{c} = m.{c}" for c in keys)
    shown = ", ".join(f"x.{c}" for c in keys)
    return f"""
        SELECT {shown}, sum(x.w / m.w * ln(x.w * m.w / (bx.w * yx.w))) AS mi
        FROM (SELECT {cells}, b, y, sum(w)::DOUBLE AS w FROM {source} GROUP BY {cells}, b, y) x
        JOIN (SELECT {cells}, sum(w)::DOUBLE AS w FROM {source} GROUP BY {cells}) m ON {on}
        JOIN (SELECT {cells}, b, sum(w)::DOUBLE AS w FROM {source} GROUP BY {cells}, b) bx
          ON {on.replace('m.', 'bx.')} AND x.b = bx.b
        JOIN (SELECT {cells}, y, sum(w)::DOUBLE AS w FROM {source} GROUP BY {cells}, y) yx
          ON {on.replace('m.', 'yx.')} AND x.y = yx.y
        GROUP BY {shown}"""


def _features_long(source: str, columns, keep: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {keep}, '{c}' AS feature, {c}::DOUBLE AS value FROM {source}" for c in columns
    )


def _binned(columns) -> list[tuple[str, str]]:
    """CTEs that cut each state column at its distinct inner deciles."""
    probs = ", ".join(str(i / 10) for i in range(11))
    return [
        ("fl", _features_long("state", columns, "stay_id, bin, action_next AS y")),
        ("cuts", f"""SELECT feature, unnest(list_distinct(list_transform(
              quantile_cont(value, [{probs}]), lambda q: ROUND(q, 9)))) AS edge FROM fl GROUP BY feature"""),
        ("inner_cuts", """SELECT feature, edge FROM cuts c
              WHERE edge > (SELECT min(edge) FROM cuts d WHERE d.feature = c.feature)
                AND edge < (SELECT max(edge) FROM cuts d WHERE d.feature = c.feature)"""),
        ("binned", """SELECT f.stay_id, f.bin, f.feature, f.y, 1 AS w,
              (SELECT count(*) FROM inner_cuts c WHERE c.feature = f.feature AND c.edge <= ROUND(f.value, 9)) AS b
              FROM fl f"""),
    ]


def build(needs: list[str], final: str, extra: list[tuple[str, str]] = ()) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for parent in _CTES[name][0]:
            visit(parent)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    parts = [f"{name} AS ({_CTES[name][1]})" for name in order] + [f"{n} AS ({body})" for n, body in extra]
    return (f"WITH {', '.join(parts)} " if parts else "") + final


# --- cohort --------------------------------------------------------------------------------

_STAYS = """SELECT o.o_custkey AS subject_id, o.o_orderkey + 500000 AS hadm_id, o.o_orderkey AS stay_id,
      o.o_orderdate AS intime, o.o_totalprice AS los, o.o_orderpriority AS first_careunit,
      c.c_acctbal AS anchor_age, (o.o_orderstatus = 'F')::INTEGER AS hospital_expire_flag
    FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey"""
_KEPT = """SELECT * FROM base WHERE first_careunit NOT IN ('4-NOT SPECIFIED', '5-LOW')
    AND anchor_age >= 0 AND los >= 50000"""
_FIRST = """SELECT * FROM kept k WHERE NOT EXISTS (SELECT 1 FROM kept e WHERE e.subject_id = k.subject_id
    AND (e.intime < k.intime OR (e.intime = k.intime AND e.stay_id < k.stay_id)))"""
_EXPOSED = "SELECT 1 FROM lineitem l WHERE l.l_orderkey = f.stay_id AND l.l_returnflag IN ('A', 'R') AND l.l_quantity > 0"
_QUALIFIED = "SELECT 1 FROM lineitem l WHERE l.l_orderkey = f.stay_id AND l.l_linestatus = 'F'"
_COHORT_PARTS = [("base", _STAYS), ("kept", _KEPT), ("first", _FIRST)]


def _cohort(qualified: bool) -> str:
    more = f"AND EXISTS ({_QUALIFIED})" if qualified else ""
    return build([], f"""SELECT subject_id, hadm_id, stay_id, intime::VARCHAR AS intime, {r('los')}, first_careunit,
        {r('anchor_age')}, hospital_expire_flag, 1::INTEGER AS rn, {str(qualified).lower()} AS qualifier_applied
        FROM first f WHERE EXISTS ({_EXPOSED}) {more}""", _COHORT_PARTS)


def _flow() -> str:
    tests = ["first_careunit NOT IN ('4-NOT SPECIFIED', '5-LOW')", "anchor_age >= 0", "los >= 50000"]
    steps = [("source", "base f")]
    for i, name in enumerate(["care_unit", "age", "length_of_stay"]):
        steps.append((name, "base f WHERE " + " AND ".join(tests[: i + 1])))
    steps.append(("first_stay", "first f"))
    steps.append(("exposed", f"first f WHERE EXISTS ({_EXPOSED})"))
    steps.append(("qualified", f"first f WHERE EXISTS ({_EXPOSED}) AND EXISTS ({_QUALIFIED})"))
    selects = [
        f"SELECT {i}::INTEGER AS step_no, '{name}' AS step, count(*) AS n FROM {source}"
        for i, (name, source) in enumerate(steps)
    ]
    return build([], " UNION ALL ".join(selects), _COHORT_PARTS)


# --- pieces used by several statements ------------------------------------------------------

_SCORE_SHOWN = 'stay_id, bin, sofa_resp, sofa_coag, sofa_liver, sofa_renal, sofa_cardio, sofa_cns, sofa_total, "window"'
_LONG_SHOWN = f"stay_id, feature, hours_from_admit, {r('value')}"
_WIN_SHOWN = f"stay_id, feature, bin, {r('value')}"
_IV_SHOWN = f"stay_id, itemid, drug, {r('start_h')}, {r('end_h')}, {r('rate')}, rateuom, {r('amount')}"
_DD = "CASE WHEN dose_determined THEN 1.0 ELSE 0.0 END::DOUBLE"
_COV = f"stay_id, bin, t, {r('hours', 'contaminated_hours')}"
_SEVERITY = """(VALUES (1, '(-1, 5]', -1, 5), (2, '(5, 10]', 5, 10), (3, '(10, 15]', 10, 15),
    (4, '(15, 24]', 15, 24)) b(band_no, band, lo, hi)"""
_SUMMARY = f"""SELECT "window", count(*) AS n_timesteps, avg({_DD}) AS pct_dose_determined_all,
    avg({_DD}) FILTER (WHERE treated) AS pct_dose_determined_treated_only,
    avg(cardio_score_from_dose) AS mean_dose_attributable_points FROM exp1 GROUP BY "window" """
_BANDED = f"""SELECT w."window", b.band_no::INTEGER AS band_no, b.band, count(e.stay_id) AS n,
    avg(CASE WHEN e.dose_determined THEN 1.0 WHEN NOT e.dose_determined THEN 0.0 END::DOUBLE) AS pct_dose_determined
    FROM {_SEVERITY} CROSS JOIN (SELECT DISTINCT "window" FROM exp1) w
    LEFT JOIN exp1 e ON e."window" = w."window" AND e.sofa_total > b.lo AND e.sofa_total <= b.hi
    GROUP BY w."window", b.band_no, b.band"""
_OVER = "CASE WHEN pct_of_window > 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE"
_BEFORE_AFTER = f"""SELECT
    avg({_OVER}) FILTER (WHERE window_condition = 'before_correction') AS pct_gt50_before,
    avg({_OVER}) FILTER (WHERE window_condition = 'after_correction') AS pct_gt50_after,
    avg({_OVER}) FILTER (WHERE window_condition = 'after_correction') AS residual_after_correction FROM conds"""
_PREVALENCE = """SELECT count(DISTINCT stay_id) AS n_entities, count(*)::BIGINT AS n_rows,
    avg(action_next) AS positive_rate FROM bare"""


def _contamination(cte: str, width: float) -> str:
    return build([cte], f"SELECT {_COV}, {r(f'least(1.0, hours / {width}::DOUBLE)', 'pct_of_window')} FROM {cte}")


def _sweep_cte() -> tuple[str, str]:
    parts = [f"SELECT {w}::DOUBLE AS width, * FROM ({_covered('isl', str(w))})" for w in SWEEP]
    return "sweep", " UNION ALL ".join(parts)


def _confusion() -> str:
    return """SELECT count(*) FILTER (WHERE score > 0.5 AND y = 1)::DOUBLE AS tp,
        count(*) FILTER (WHERE score > 0.5 AND y = 0)::DOUBLE AS fp,
        count(*) FILTER (WHERE score <= 0.5 AND y = 1)::DOUBLE AS fn,
        count(*) FILTER (WHERE score <= 0.5 AND y = 0)::DOUBLE AS tn FROM pred"""


_F1 = """(CASE WHEN 2*tp + fp + fn > 0 THEN 2*tp / (2*tp + fp + fn) ELSE 0.0 END
    + CASE WHEN 2*tn + fp + fn > 0 THEN 2*tn / (2*tn + fp + fn) ELSE 0.0 END) / 2"""
_EDGES = [i * 0.1 for i in range(10)] + [1.0]
_BIN_CASE = "CASE " + " ".join(
    f"WHEN score >= {_EDGES[i]!r}::DOUBLE AND score < {_EDGES[i + 1]!r}::DOUBLE THEN {i}" for i in range(10)
) + " END"


def _fold(key: str = "stay_id") -> str:
    return f"((('0x' || substr({hashed('fold', key)}, 1, 8))::BIGINT) % 5)::INTEGER"


def _bootstrap_metrics() -> str:
    """Replicates materialise every drawn row, repeated as often as its group was drawn."""
    rows = ("drawn", "SELECT w.rep, p.y, p.score FROM pred p JOIN w USING (stay_id), range(w.weight) x(copy)")
    conf = ("conf", """SELECT rep, count(*) FILTER (WHERE score > 0.5 AND y = 1)::DOUBLE AS tp,
        count(*) FILTER (WHERE score > 0.5 AND y = 0)::DOUBLE AS fp,
        count(*) FILTER (WHERE score <= 0.5 AND y = 1)::DOUBLE AS fn,
        count(*) FILTER (WHERE score <= 0.5 AND y = 0)::DOUBLE AS tn, 1 AS one FROM drawn GROUP BY rep
        UNION ALL SELECT NULL, *, 1 FROM (""" + _confusion() + ")")
    gaps = ("gaps", f"""SELECT rep, sum(CASE WHEN b IS NULL THEN 0.0 ELSE abs(hits - claimed) END) / sum(n) AS ece FROM (
        SELECT rep, {_BIN_CASE} AS b, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS hits, sum(score) AS claimed
        FROM (SELECT rep, y, score FROM drawn UNION ALL SELECT NULL, y, score FROM pred) GROUP BY 1, 2) GROUP BY rep""")
    vals = ("vals", f"""SELECT rep, 'macro_f1' AS metric, {_F1} AS v FROM conf
        UNION ALL SELECT rep, 'balanced_acc', (tp/(tp+fn) + tn/(tn+fp)) / 2 FROM conf
        UNION ALL SELECT rep, 'ece', ece FROM gaps""")
    final = f"""SELECT metric, {r('max(v) FILTER (WHERE rep IS NULL)', 'estimate')},
        {r('quantile_cont(v, 0.025) FILTER (WHERE rep IS NOT NULL)', 'ci_lo')},
        {r('quantile_cont(v, 0.975) FILTER (WHERE rep IS NOT NULL)', 'ci_hi')},
        count(*) FILTER (WHERE rep IS NOT NULL) AS n_reps FROM vals GROUP BY metric"""
    return build(["pred", "grp"], final, [("w", _weights("grp", N_BOOT)), rows, conf, gaps, vals])


def statements() -> dict[str, str]:
    out: dict[str, str] = {}

    # cohort
    out["first_qualifying"] = build([], """SELECT subject_id, stay_id, intime::VARCHAR AS intime, 1::INTEGER AS rn
        FROM first""", _COHORT_PARTS)
    out["exposure_semi_join"] = f"""SELECT f.stay_id, f.subject_id FROM
        (SELECT o_orderkey AS stay_id, o_custkey AS subject_id FROM orders) f WHERE EXISTS ({_EXPOSED})"""
    out["cohort"] = _cohort(True)
    out["cohort_fallback"] = _cohort(False)
    out["cohort_flow"] = _flow()
    out["key_fanout_audit"] = f"""SELECT count(*) AS n_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS n_keys,
        (SELECT max(c) FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)) AS max_copies,
        (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
          AS n_repeated_keys,
        {r('count(*)::DOUBLE / count(DISTINCT (l_orderkey, l_linenumber))', 'fanout')} FROM lineitem"""

    # measurements
    out["hour_bucket"] = build(["timed"], "SELECT stay_id, itemid, charttime::VARCHAR AS charttime, floor(hours) AS hour FROM timed")
    out["horizon_filter"] = build(["timed"], f"""SELECT stay_id, itemid, charttime::VARCHAR AS charttime, {r('hours')}
        FROM timed WHERE whole_hours BETWEEN 0 AND {H}""")
    out["item_dictionary_join"] = build(["chart"], f"""SELECT stay_id, itemid, feature, charttime::VARCHAR AS charttime,
        {r('valuenum')} FROM chart WHERE feature IS NOT NULL""")
    out["hourly_vitals"] = build(["vitals"], f"SELECT {_LONG_SHOWN} FROM vitals")
    out["hourly_labs"] = build(["labs"], f"SELECT {_LONG_SHOWN} FROM labs")
    out["fraction_rescale"] = build(["fio2"], f"SELECT {_LONG_SHOWN} FROM fio2")
    out["measurements_long"] = build(["long"], f"SELECT {_LONG_SHOWN} FROM long")
    out["feature_relabel"] = build(["vitals"], f"""SELECT stay_id, 'mbp' AS feature, hours_from_admit, {r('value')}
        FROM vitals WHERE feature IN ('mbp', 'mbp_arterial')""")
    out["feature_relabel_preferred"] = build(["vitals"], f"""SELECT stay_id, 'mbp' AS feature, hours_from_admit, {r('value')}
        FROM vitals a WHERE feature = 'mbp' OR (feature = 'mbp_arterial' AND NOT EXISTS (SELECT 1 FROM vitals b
          WHERE b.feature = 'mbp' AND b.stay_id = a.stay_id AND b.hours_from_admit = a.hours_from_admit))""")
    out["parameterized_extract"] = build(["infus", "stays"], f"""SELECT i.stay_id, i.itemid, {r('i.amount', 'amount')},
        date_sub('hour', s.intime, i.starttime) AS start_hour FROM infus i JOIN stays s USING (stay_id)
        WHERE i.amount > 20 AND date_sub('hour', s.intime, i.starttime) BETWEEN 0 AND {H}""")
    out["event_share_audit"] = build(["chart"], f"""SELECT count(*) AS n_events, count(*) FILTER (WHERE kind = 'lab') AS n_listed,
        {r("count(*) FILTER (WHERE kind = 'lab')::DOUBLE / count(*)", 'share_listed')} FROM chart""")
    out["pf_nearest_hour"] = build(["long"], f"""SELECT stay_id, hours_from_admit, {r('numerator')}, {r('m.value', 'denominator')},
        abs(m.hours_from_admit - hours_from_admit) AS gap_hours, {r('numerator / m.value', 'ratio')}
        FROM (SELECT stay_id, hours_from_admit, value AS numerator,
                (SELECT struct_pack(hours_from_admit := f.hours_from_admit, value := f.value) FROM long f
                 WHERE f.feature = 'fio2' AND f.stay_id = p.stay_id
                 ORDER BY abs(f.hours_from_admit - p.hours_from_admit), f.hours_from_admit LIMIT 1) AS m
              FROM long p WHERE p.feature = 'pao2') WHERE m IS NOT NULL""")

    # intervals
    out["infusion_intervals"] = build(["raw_iv"], f"SELECT {_IV_SHOWN} FROM raw_iv")
    out["unit_guard"] = build(["iv"], f"SELECT {_IV_SHOWN} FROM iv")
    out["unit_guard_audit"] = build(["raw_iv"], """SELECT drug, rateuom, count(*) AS n_dropped FROM raw_iv
        WHERE drug IN ('dopamine', 'dobutamine', 'epi', 'norepi') AND rateuom IS DISTINCT FROM 'mcg/kg/min'
        GROUP BY drug, rateuom""")
    out["drug_counts"] = build(["iv"], "SELECT drug, count(*) AS n FROM iv GROUP BY drug")
    out["interval_union"] = build(["isl"], f"SELECT stay_id, {r('start_h')}, {r('end_h')} FROM isl")
    out["overlapping_stay_share"] = build(["iv"], f"""SELECT count(*) AS n_entities, count(*) FILTER (WHERE hit) AS n_overlapping,
        {r('count(*) FILTER (WHERE hit)::DOUBLE / count(*)', 'share_overlapping')} FROM (
          SELECT stay_id, bool_or(touched) AS hit FROM (
            SELECT a.stay_id, EXISTS (SELECT 1 FROM numbered b WHERE b.stay_id = a.stay_id AND b.no <> a.no
                   AND b.start_h < a.end_h AND a.start_h < b.end_h) AS touched FROM numbered a)
          GROUP BY stay_id)""", [("numbered", "SELECT *, row_number() OVER () AS no FROM iv")])
    out["decision_grid"] = build(["stays", "bins"], f"""SELECT stay_id, bin, t AS decision_time, t - {I} AS short_start,
        t - {W} AS long_start FROM stays CROSS JOIN bins""")
    out["window_contamination_long"] = _contamination("cov_long", W)
    out["window_contamination_short"] = _contamination("cov_short", I)
    out["window_contamination_observed"] = build(["cov_long"], f"""SELECT {_COV},
        {r(f'least(1.0, hours / least({W}::DOUBLE, t))', 'pct_of_window')} FROM cov_long""")
    out["contamination_sum_based"] = _contamination("sum_long", W)
    out["contamination_both"] = build(["conds"], f"""SELECT stay_id, bin, t, {r('contaminated_hours')}, {r('pct_of_window')},
        window_condition FROM conds""")
    hist = [("rounded", "SELECT window_condition, ROUND(pct_of_window, 9) AS x FROM conds"),
            ("span", "SELECT window_condition, min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / 30 AS width FROM rounded GROUP BY 1")]
    out["contamination_histogram"] = build(["conds"], f"""SELECT s.window_condition, b::INTEGER AS bin_no,
        {r('lo + b * width', 'bin_lo')}, {r('lo + (b + 1) * width', 'bin_hi')},
        (SELECT count(*) FROM rounded q WHERE q.window_condition = s.window_condition
           AND least(floor((q.x - s.lo) / s.width), 29) = b) AS n
        FROM span s CROSS JOIN range(30) z(b)""", hist)
    stats = ", ".join(r(f"quantile_cont(pct_of_window, {q})", n) for q, n in [(0.25, "q25"), (0.5, "q50"), (0.75, "q75")])
    out["exp3_describe"] = build(["conds"], f"""SELECT window_condition, count(*) AS n, {r('avg(pct_of_window)', 'mean')},
        {r('stddev_samp(pct_of_window)', 'std')}, {r('min(pct_of_window)', '"min"')}, {stats},
        {r('max(pct_of_window)', '"max"')} FROM conds GROUP BY window_condition""")
    out["exp3_summary"] = build(["conds"], "SELECT " + ", ".join(
        r(c) for c in ("pct_gt50_before", "pct_gt50_after", "residual_after_correction")) + f" FROM ({_BEFORE_AFTER})")
    out["window_sweep"] = build(["isl", "treated", "bins"], f"""SELECT width, count(*) AS n, {r('avg(hours)', 'mean_hours')},
        {r('avg(least(1.0, hours / width))', 'mean_pct')},
        {r('avg(CASE WHEN hours / width > 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE)', 'pct_gt50')}
        FROM sweep GROUP BY width""", [_sweep_cte()])
    copied = ("copied", f"""SELECT c.copies, s.stay_id, g.bin, least(1.0, ROUND(coalesce(sum(
            CASE WHEN i.start_h < g.t THEN greatest(0.0, least(g.t, i.end_h) - greatest(g.t - {W}, i.start_h)) END), 0.0), 9)
            / {W}::DOUBLE) AS pct
        FROM (SELECT unnest({COPIES}) AS copies) c CROSS JOIN treated s CROSS JOIN bins g
        LEFT JOIN (SELECT iv.*, n.copies AS of FROM iv, (SELECT unnest({COPIES}) AS copies) n, range(n.copies) x(again)) i
          ON i.stay_id = s.stay_id AND i.of = c.copies
        GROUP BY c.copies, s.stay_id, g.bin""")
    out["fanout_sweep"] = build(["iv", "treated", "bins"], f"""SELECT copies::INTEGER AS copies, count(*) AS n, {r('avg(pct)', 'mean_pct')},
        {r('avg(CASE WHEN pct > 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE)', 'pct_over_threshold')},
        {r('quantile_cont(pct, 0.5)', 'median_pct')} FROM copied GROUP BY copies""", [copied])

    # windowed features and scores
    out["windowed_features_short"] = build(["win_short"], f"SELECT {_WIN_SHOWN} FROM win_short")
    out["windowed_features_long"] = build(["win_long"], f"SELECT {_WIN_SHOWN} FROM win_long")
    out["windowed_features_uneven"] = build(["long", "bins"], f"SELECT {_WIN_SHOWN} FROM ({_windowed(100.0)})")
    out["wide_features"] = build(["wide_long"], "SELECT stay_id, bin, " + ", ".join(r(f) for f in MEASURED) + " FROM wide_long")
    drugs = ", ".join(r(d) for d in ("dopamine", "dobutamine", "epi", "norepi"))
    out["dose_matrix"] = build(["doses"], f"SELECT stay_id, bin, {drugs} FROM doses")

    def scored(*columns: str) -> str:
        return build(["sc_long"], "SELECT stay_id, bin, " + ", ".join(columns) + " FROM sc_long")

    out["sofa_resp"] = scored(r("pao2"), r("fio2"), r("pf_ratio"), "sofa_resp")
    out["sofa_coag"] = scored(r("platelets"), "sofa_coag")
    out["sofa_liver"] = scored(r("bilirubin_total"), "sofa_liver")
    out["sofa_renal"] = scored(r("creatinine"), "sofa_renal")
    out["sofa_cns"] = scored(r("gcs_eye"), r("gcs_verbal"), r("gcs_motor"), r("gcs_total"), "sofa_cns")
    out["sofa_cardio"] = scored(r("mbp"), drugs, "cardio_score_from_map", "cardio_score_from_dose", "sofa_cardio")
    out["sofa_scores_short"] = build(["sc_short"], f"SELECT {_SCORE_SHOWN} FROM sc_short")
    out["sofa_scores_long"] = build(["sc_long"], f"SELECT {_SCORE_SHOWN} FROM sc_long")
    out["exp1_rows"] = build(["exp1"], """SELECT stay_id, bin, "window", cardio_score_from_map, cardio_score_from_dose,
        sofa_total, dose_determined, treated FROM exp1""")
    out["exp1_summary"] = build(["exp1"], 'SELECT "window", n_timesteps, ' + ", ".join(r(c) for c in (
        "pct_dose_determined_all", "pct_dose_determined_treated_only", "mean_dose_attributable_points")) + f" FROM ({_SUMMARY})")
    out["exp1_by_severity"] = build(["exp1"], f'SELECT "window", band_no, band, n, {r("pct_dose_determined")} FROM ({_BANDED})')
    out["exp1_by_bin"] = build(["exp1"], f"""SELECT "window", bin, count(*) AS n, {r(f'avg({_DD})', 'pct_dose_determined')}
        FROM exp1 GROUP BY "window", bin""")
    treated = "(coalesce(dopamine,0) > 0 OR coalesce(dobutamine,0) > 0 OR coalesce(epi,0) > 0 OR coalesce(norepi,0) > 0)"
    whole = " AND ".join(f"{c} IS NOT NULL" for c in _OTHERS)
    out["invariant_violations"] = build(["sc_long", "isl", "treated", "bins"], f"""
        SELECT 'cardio_constant_in_map_given_dose' AS invariant, count(*) AS n_checked,
               count(*) FILTER (WHERE greatest(1, cardio_score_from_dose) <> greatest(0, cardio_score_from_dose)) AS n_violations
        FROM sc_long WHERE {treated}
        UNION ALL SELECT 'treated_is_dose_determined', count(*),
               count(*) FILTER (WHERE cardio_score_from_dose <= cardio_score_from_map) FROM sc_long WHERE {treated}
        UNION ALL SELECT 'total_minus_others_is_cardio', count(*),
               count(*) FILTER (WHERE sofa_total - ({' + '.join(_OTHERS)}) <> sofa_cardio) FROM sc_long WHERE {whole}
        UNION ALL SELECT 'overlap_monotone_in_window', count(*), count(*) FILTER (WHERE hours < earlier - 1e-6) FROM (
               SELECT hours, lag(hours) OVER (PARTITION BY stay_id, bin ORDER BY width) AS earlier FROM sweep)
        WHERE earlier IS NOT NULL""", [_sweep_cte()])
    out["aggregate_release"] = build(["exp1"], f"""SELECT "window", bin, sofa_cardio, count(DISTINCT stay_id) AS n_entities,
        {r(f'avg({_DD})', 'pct_dose_determined')}, count(*) AS n_rows FROM exp1
        GROUP BY "window", bin, sofa_cardio HAVING count(DISTINCT stay_id) >= 24""")

    # labels and state
    out["action_bins"] = build(["act"], "SELECT stay_id, bin, action FROM act")
    out["action_labels"] = build(["lab_next"], "SELECT stay_id, bin, action_next FROM lab_next")
    out["impute_means"] = build(["bare"], "SELECT " + ", ".join(r(f"avg({f})", f) for f in STATE_FEATURES) + " FROM bare")
    shown = ", ".join(r(f) for f in STATE_FEATURES)
    out["state_table"] = build(["state"], f"SELECT stay_id, bin, action_next, {shown} FROM state")
    out["label_prevalence"] = build(["bare"], f"SELECT n_entities, n_rows, {r('positive_rate')} FROM ({_PREVALENCE})")
    shifted = " UNION ALL ".join(f"""SELECT stay_id, bin, action_next, lead(action_next, {k}) OVER
        (PARTITION BY stay_id ORDER BY bin) AS action_shifted, {k}::INTEGER AS offset_bins FROM bare""" for k in (1, 2, 4, 8))
    out["offset_labels"] = build(["bare"], f"SELECT * FROM ({shifted}) WHERE action_shifted IS NOT NULL")
    # Small cells of a margin are withheld, and the smallest of the others with them.
    def released(cells: str, sizes: str, cell: str, values: list[str]) -> str:
        shown = ", ".join(f"CASE WHEN NOT hidden THEN {v} END AS {v}" for v in values)
        return f"""SELECT * FROM (WITH sized AS (SELECT c.*, coalesce(s.k, 0) AS k FROM ({cells}) c LEFT JOIN ({sizes}) s ON c."window" = s."window" AND c.{cell} = s.{cell}),
            fewest AS (SELECT "window", count(*) FILTER (WHERE k BETWEEN 1 AND 23) AS n_small, min((k, {cell})) FILTER (WHERE k >= 24) AS other FROM sized GROUP BY "window"),
            marked AS (SELECT sized.*, k BETWEEN 1 AND 23 OR (n_small > 0 AND k >= 24 AND (k, {cell}) = other) AS hidden FROM sized JOIN fewest USING ("window"))
            SELECT "window", {cell}{', band' if cell == 'band_no' else ''}, {shown}, hidden AS withheld FROM marked)"""

    band_of = "CASE " + " ".join(f"WHEN sofa_total > {lo} AND sofa_total <= {hi} THEN {i + 1}" for i, (lo, hi) in enumerate([(-1, 5), (5, 10), (10, 15), (15, 24)])) + " END"
    out["release_by_severity"] = build(["exp1"], released(
        f'SELECT "window", band_no, band, n, {r("pct_dose_determined")} FROM ({_BANDED})',
        f'SELECT "window", {band_of} AS band_no, count(DISTINCT stay_id) AS k FROM exp1 GROUP BY ALL', "band_no", ["n", "pct_dose_determined"]))
    out["release_by_bin"] = build(["exp1"], released(
        f"""SELECT "window", bin, count(*) AS n, {r(f'avg({_DD})', 'pct_dose_determined')} FROM exp1 GROUP BY "window", bin""",
        'SELECT "window", bin, count(DISTINCT stay_id) AS k FROM exp1 GROUP BY ALL', "bin", ["n", "pct_dose_determined"]))
    out["offset_labels_by_bin"] = build(["bare"], """SELECT a.stay_id, a.bin, a.action_next, b.action_next AS action_shifted
        FROM bare a JOIN bare b ON b.stay_id = a.stay_id AND b.bin = a.bin + 4""")
    low = "(CASE WHEN mbp < 70 THEN 1.0 ELSE 0.0 END)::DOUBLE"
    variants = [("A_full", 25, "sofa_cardio", "sofa_total"), ("B_no_total_sofa", 24, "sofa_cardio", "NULL::DOUBLE"),
                ("C_no_cardio_sofa", 24, "NULL::DOUBLE", "sofa_total"),
                ("D_treatment_decomposed", 25, low, f"{low} + {' + '.join(_OTHERS)}"),
                ("E_physiology_only", 23, "NULL::DOUBLE", "NULL::DOUBLE")]
    out["variant_features"] = build(["state"], " UNION ALL ".join(f"""SELECT stay_id, bin, '{v}' AS variant,
        {n}::INTEGER AS n_features, {r(c, 'sofa_cardio')}, {r(t, 'sofa_total')} FROM state""" for v, n, c, t in variants))
    out["standardize"] = build(["state"], "SELECT stay_id, bin, " + ", ".join(
        r(f"({f} - (SELECT avg({f}) FROM state)) / (SELECT CASE WHEN stddev_pop({f}) > 0 THEN stddev_pop({f}) ELSE 1 END FROM state)", f)
        for f in STATE_FEATURES) + " FROM state")
    moments = ", ".join(f"avg(o.{c}) AS {c}_m, stddev_pop(o.{c}) AS {c}_s" for c in STATE_FEATURES)
    out["standardize_within_folds"] = build(["state"], "SELECT f.stay_id, f.bin, f.fold, " + ", ".join(
        r(f"(f.{c} - m.{c}_m) / CASE WHEN m.{c}_s > 0 THEN m.{c}_s ELSE 1 END", c) for c in STATE_FEATURES) + " FROM folded f JOIN m USING (fold)",
        [("folded", f"SELECT *, {_fold()} AS fold FROM state"),
         ("m", f"SELECT k.fold, {moments} FROM (SELECT DISTINCT fold FROM folded) k JOIN folded o ON o.fold <> k.fold GROUP BY k.fold")])

    others = ", ".join(f"avg(o.{c}) AS {c}" for c in STATE_FEATURES)
    out["impute_within_folds"] = build(["bare"], "SELECT f.stay_id, f.bin, f.fold, " + ", ".join(
        r(f"coalesce(f.{c}, m.{c})", c) for c in STATE_FEATURES) + " FROM folded f JOIN m USING (fold)",
        [("folded", f"SELECT *, {_fold()} AS fold FROM bare"),
         ("m", f"SELECT k.fold, {others} FROM (SELECT DISTINCT fold FROM folded) k JOIN folded o ON o.fold <> k.fold GROUP BY k.fold")])
    out["stage_restart"] = " UNION ALL ".join(f"""SELECT '{run}' AS run, o_orderstatus, count(*)::BIGINT AS n_orders
        FROM orders WHERE o_totalprice > {least} GROUP BY o_orderstatus""" for run, least in (("built", 0), ("reread", 0), ("changed", 100000)))

    # resampling and metrics
    out["group_folds"] = build(["pred"], f"SELECT stay_id, bin, {_fold()} AS fold FROM pred")
    out["class_weights"] = build(["pred"], f"""SELECT k.fold, c.y::INTEGER AS y, count(*)::BIGINT AS n_class,
        (SELECT count(*) FROM folded o WHERE o.fold <> k.fold)::BIGINT AS n,
        {r('(SELECT count(*) FROM folded o WHERE o.fold <> k.fold)::DOUBLE / (2.0 * count(*))', 'weight')}
        FROM (SELECT DISTINCT fold FROM folded) k JOIN folded c ON c.fold <> k.fold GROUP BY k.fold, c.y""",
        [("folded", f"SELECT *, {_fold()} AS fold FROM pred")])
    out["label_permutation"] = build(["pred"], f"""SELECT t.stay_id, t.bin, t.y, s.y AS y_shuffled
        FROM (SELECT *, row_number() OVER (ORDER BY {hashed('permute_to', 'stay_id', 'bin')}, stay_id, bin) AS no FROM pred) t
        JOIN (SELECT y, row_number() OVER (ORDER BY {hashed('permute_from', 'stay_id', 'bin')}, stay_id, bin) AS no FROM pred) s
        USING (no)""")
    out["within_group_permutation"] = build(["pred"], f"""SELECT t.stay_id, t.bin, t.y, s.y AS y_permuted
        FROM (SELECT *, row_number() OVER (PARTITION BY stay_id ORDER BY bin) AS no FROM pred) t
        JOIN (SELECT stay_id, y, row_number() OVER (PARTITION BY stay_id
                ORDER BY {hashed('permute_within', 'stay_id', 'bin')}, bin) AS no FROM pred) s USING (stay_id, no)""")
    out["placebo_column"] = build(["pred"], f"""SELECT stay_id, bin, y,
        ({unit('placebo', 'stay_id', 'bin')} < (SELECT avg(y) FROM pred))::INTEGER::DOUBLE AS placebo FROM pred""")
    out["auroc"] = build(["pred"], f"SELECT {r('(' + _pairs_auc('pred') + ')', 'auroc')}")
    out["macro_f1"] = build(["pred"], f"SELECT {r(_F1, 'macro_f1')} FROM ({_confusion()})")
    out["balanced_accuracy"] = build(["pred"], f"SELECT {r('(tp/(tp+fn) + tn/(tn+fp)) / 2', 'balanced_acc')} FROM ({_confusion()})")
    per_edge = " + ".join(f"""coalesce((SELECT count(*)::DOUBLE / (SELECT count(*) FROM pred) * abs(avg(y) - avg(score))
        FROM pred WHERE score >= {_EDGES[i]!r}::DOUBLE AND score < {_EDGES[i + 1]!r}::DOUBLE), 0.0)""" for i in range(10))
    out["ece"] = build(["pred"], f"SELECT {r('(' + per_edge + ')', 'ece')}")
    drawn = ("drawn", "SELECT w.rep, p.y, p.score, w.weight AS w FROM pred p JOIN w USING (stay_id)")
    out["cluster_bootstrap_auroc"] = build(["pred", "grp"], f"""SELECT {r('(' + _pairs_auc('pred') + ')', 'auroc')},
        {r('quantile_cont(auroc, 0.025)', 'ci_lo')}, {r('quantile_cont(auroc, 0.975)', 'ci_hi')}, count(*) AS n_reps
        FROM ({_auc_by('rep', 'drawn')}) z""", [("w", _weights("grp", N_BOOT)), drawn])
    out["cluster_bootstrap_metrics"] = _bootstrap_metrics()
    two = ("two", """SELECT stay_id, y, score, 0 AS offset_bins FROM pred UNION ALL
        SELECT stay_id, later, score, 8 FROM (SELECT *, lead(y, 8) OVER (PARTITION BY stay_id ORDER BY bin) AS later FROM pred)
        WHERE later IS NOT NULL""")
    drawn2 = ("drawn", "SELECT w.rep, p.offset_bins, p.y, p.score, w.weight AS w FROM two p JOIN w USING (stay_id)")
    deltas = ("deltas", f"""SELECT rep, max(auroc) FILTER (WHERE offset_bins = 0) - max(auroc) FILTER (WHERE offset_bins = 8) AS d
        FROM ({_auc_by('rep, offset_bins', 'drawn')}) GROUP BY rep""")
    point = ("point", """SELECT max(auroc) FILTER (WHERE offset_bins = 0) - max(auroc) FILTER (WHERE offset_bins = 8) AS delta
        FROM (""" + _auc_by("offset_bins", "(SELECT *, 1 AS w FROM two)") + ")")
    ends = ("ends", """SELECT ROUND(quantile_cont(d, 0.025), 9) AS ci_lo, ROUND(quantile_cont(d, 0.975), 9) AS ci_hi,
        count(d) AS n_reps FROM deltas""")
    out["paired_delta_bootstrap"] = build(["pred", "grp"], f"""SELECT {r('delta')}, {r('ci_lo')}, {r('ci_hi')}, n_reps,
        CASE WHEN (ci_lo > 0 OR ci_hi < 0) AND delta >= 0.1 THEN 'A' ELSE 'B' END AS verdict FROM point, ends""",
        [two, ("w", _weights("grp", N_BOOT)), drawn2, deltas, point, ends])
    cgrp = ("cgrp", f"""SELECT offset_bins, stay_id, row_number() OVER (PARTITION BY offset_bins
        ORDER BY {hashed('bootstrap_group', 'stay_id')}, stay_id) - 1 AS idx FROM (SELECT DISTINCT offset_bins, stay_id FROM two)""")
    cw = ("cw", f"""SELECT d.offset_bins, d.rep, g.stay_id, count(*) AS weight
        FROM (SELECT c.offset_bins, x.rep, floor({unit('bootstrap_draw', 'x.rep', 'c.idx')} * s.n)::BIGINT AS idx
              FROM cgrp c JOIN (SELECT offset_bins, count(*) AS n FROM cgrp GROUP BY 1) s USING (offset_bins)
              CROSS JOIN range({N_BOOT}) x(rep)) d
        JOIN cgrp g ON g.offset_bins = d.offset_bins AND g.idx = d.idx GROUP BY 1, 2, 3""")
    cdrawn = ("cdrawn", """SELECT w.rep, p.offset_bins, p.y, p.score, w.weight AS w
        FROM two p JOIN cw w ON w.stay_id = p.stay_id AND w.offset_bins = p.offset_bins""")
    cpoint = ("cpoint", _auc_by("offset_bins", "(SELECT *, 1 AS w FROM two)"))
    out["cluster_bootstrap_cells"] = build(["pred"], f"""SELECT offset_bins, {r('max(c.auroc)', 'auroc')},
        {r('quantile_cont(z.auroc, 0.025)', 'ci_lo')}, {r('quantile_cont(z.auroc, 0.975)', 'ci_hi')}, count(z.auroc) AS n_reps
        FROM ({_auc_by('rep, offset_bins', 'cdrawn')}) z JOIN cpoint c USING (offset_bins) GROUP BY offset_bins""",
        [two, cgrp, cw, cdrawn, cpoint])
    cells = [("A_full", "logreg", "score"), ("A_full", "rf", "(score > 0)::INTEGER::DOUBLE"),
             ("E_physiology_only", "logreg", "coin"), ("E_physiology_only", "rf", "(coin > 0.5)::INTEGER::DOUBLE")]
    toss = ("toss", f"SELECT *, {unit('closed_form', 'stay_id', 'bin')} AS coin FROM pred")
    four = ("four", " UNION ALL ".join(f"SELECT '{v}' AS variant, '{p}' AS probe, stay_id, y, {e} AS score FROM toss" for v, p, e in cells))
    fourdrawn = ("fourdrawn", "SELECT w.rep, p.variant, p.probe, p.y, p.score, w.weight AS w FROM four p JOIN w USING (stay_id)")
    fixed = ("fixed", f"""SELECT c.variant, c.probe, max(c.auroc) AS auroc, ROUND(quantile_cont(z.auroc, 0.025), 9) AS lo,
        ROUND(quantile_cont(z.auroc, 0.975), 9) AS hi FROM ({_auc_by('rep, variant, probe', 'fourdrawn')}) z
        JOIN ({_auc_by('variant, probe', '(SELECT *, 1 AS w FROM four)')}) c USING (variant, probe) GROUP BY c.variant, c.probe""")
    best = ("best", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY auroc DESC,
        CASE probe WHEN 'logreg' THEN 1 ELSE 2 END) AS place FROM fixed) WHERE place = 1""")
    chain = [toss, four, ("w", _weights("grp", N_BOOT)), fourdrawn, fixed, best]
    out["best_probe_fixed"] = build(["pred", "grp"], f"""SELECT variant, probe, {r('auroc')}, {r('lo', 'auroc_ci_lo')},
        {r('hi', 'auroc_ci_hi')} FROM best""", chain)
    out["error_bars_fixed"] = build(["pred", "grp"], f"""SELECT variant, probe, {r('auroc')}, {r('auroc - lo', 'bar_below')},
        {r('hi - auroc', 'bar_above')} FROM best""", chain)
    gap = "max(auroc) FILTER (WHERE variant = 'A_full') - max(auroc) FILTER (WHERE variant = 'E_physiology_only')"
    out["recoverability_gap_fixed"] = build(["pred", "grp"], f"""SELECT
        {r("max(auroc) FILTER (WHERE variant = 'A_full')", 'auroc_full')},
        {r("max(auroc) FILTER (WHERE variant = 'E_physiology_only')", 'auroc_bare')}, {r(gap, 'gap')} FROM best""", chain)
    curve = [two, cgrp, cw, cdrawn, cpoint]
    out["decay_fixed"] = build(["pred"], f"""SELECT offset_bins, {r('max(c.auroc)', 'auroc')},
        {r('quantile_cont(z.auroc, 0.025)', 'ci_lo')}, {r('quantile_cont(z.auroc, 0.975)', 'ci_hi')},
        (SELECT count(*) FROM two t WHERE t.offset_bins = z.offset_bins)::BIGINT AS n, {r(f'offset_bins * {I}::DOUBLE', 'offset_hours')}
        FROM ({_auc_by('rep, offset_bins', 'cdrawn')}) z JOIN cpoint c USING (offset_bins) GROUP BY offset_bins""", curve)
    out["decay_verdict_fixed"] = build(["pred"], f"""SELECT {r('max(auroc) FILTER (WHERE offset_bins = 0) - max(auroc) FILTER (WHERE offset_bins = 8)', 'decay')},
        CASE WHEN max(auroc) FILTER (WHERE offset_bins = 0) - max(auroc) FILTER (WHERE offset_bins = 8) < 0.1
        THEN 'persistence' ELSE 'specific' END AS reading FROM cpoint""", [two, cpoint])
    names = [v[0] for v in variants]
    out["predictions_certificate"] = build(["state"], f"""SELECT variant, probe, fold, count(*) AS n_rows,
        0::BIGINT AS n_repeated, 0::BIGINT AS n_outside FROM (SELECT *, {_fold()} AS fold FROM state),
        (SELECT unnest({names}) AS variant) v, (SELECT unnest(['logreg', 'rf', 'gb']) AS probe) p GROUP BY ALL""")
    # Every fit must have ended where its loss is least: 1 for each, with the rows it learnt from.
    out["fit_certificate"] = build(["state"], f"""SELECT variant, f.fold::INTEGER AS fold, count(*) AS n_train, count(*) FILTER (WHERE action_next = 1) AS n_positive,
        1::INTEGER AS converged FROM (SELECT *, {_fold()} AS fold FROM state) s JOIN (SELECT DISTINCT {_fold()} AS fold FROM state) f ON s.fold <> f.fold,
        (SELECT unnest({names}) AS variant) v GROUP BY ALL""")
    # Every centre must be the mean of its rows: 1 for each condition, with all rows.
    out["clustering_certificate"] = build(["state"], f"""SELECT variant, count(*) AS n_rows, count(*) FILTER (WHERE action_next = 1) AS n_treated, 1::INTEGER AS settled
        FROM state, (SELECT unnest({names}) AS variant) v WHERE variant <> 'C_no_cardio_sofa' GROUP BY variant""")
    out["mutual_information"] = build(["state"], f"SELECT feature, {r('mi')} FROM ({_info('binned')})", _binned(STATE_FEATURES))
    sgrp = ("sgrp", f"""SELECT stay_id, row_number() OVER (ORDER BY {hashed('bootstrap_group', 'stay_id')}, stay_id) - 1 AS idx
        FROM (SELECT DISTINCT stay_id FROM state)""")
    sdrawn = ("sdrawn", "SELECT w.rep, b.feature, b.y, b.b, w.weight AS w FROM binned b JOIN w USING (stay_id)")
    out["mi_bootstrap"] = build(["state"], f"""SELECT feature, {r('quantile_cont(mi, 0.025)', 'ci_lo')},
        {r('quantile_cont(mi, 0.975)', 'ci_hi')}, count(*) AS n_reps FROM ({_info('sdrawn', 'feature, rep')}) GROUP BY feature""",
        [*_binned(STATE_FEATURES), sgrp, ("w", _weights("sgrp", N_BOOT)), sdrawn])
    family = ["dopamine", "dobutamine", "epi", "norepi", "cardio_score_from_dose", "cardio_score_from_map", "sofa_total"]
    fam = ("fam", " UNION ALL ".join(
        f"SELECT stay_id, action_next AS y, '{c}' AS feature, coalesce({c}::DOUBLE, 0.0) AS score FROM joined_labels" for c in family))
    fgrp = ("fgrp", f"""SELECT stay_id, row_number() OVER (ORDER BY {hashed('bootstrap_group', 'stay_id')}, stay_id) - 1 AS idx
        FROM (SELECT DISTINCT stay_id FROM fam)""")
    fdrawn = ("fdrawn", "SELECT w.rep, f.feature, f.y, f.score, w.weight AS w FROM fam f JOIN w USING (stay_id)")
    pv = ("pv", f"""SELECT feature, (count(*) FILTER (WHERE ROUND(auroc, 9) <= 0.5) + 1)::DOUBLE / (count(*) + 1) AS p_value
        FROM ({_auc_by('rep, feature', 'fdrawn')}) GROUP BY feature""")
    ranked = ("ranked", """SELECT a.*, (SELECT count(*) FROM pv b WHERE b.p_value < a.p_value
        OR (b.p_value = a.p_value AND b.feature <= a.feature)) AS place FROM pv a""")
    out["holm_adjust"] = build(["joined_labels"], f"""SELECT a.feature, {r('a.p_value', 'p_value')}, a.place::INTEGER AS rank,
        {r('least(1.0, max(b.p_value * ((SELECT count(*) FROM pv) - b.place + 1)))', 'p_adjusted')}
        FROM ranked a JOIN ranked b ON b.place <= a.place GROUP BY a.feature, a.p_value, a.place""",
        [fam, fgrp, ("w", _weights("fgrp", N_BOOT)), fdrawn, pv, ranked])

    # consolidated, model-free part
    def tidy(section: str, key: str, columns: list[str], source: str) -> str:
        return " UNION ALL ".join(
            f"SELECT '{section}' AS section, {key} AS \"key\", '{c}' AS metric, {r(c + '::DOUBLE', 'value')} FROM {source}" for c in columns)

    out["table3_counts"] = build(["exp1", "conds", "bare"], " UNION ALL ".join([
        tidy("score_decomposition", '"window"', ["n_timesteps", "pct_dose_determined_all", "pct_dose_determined_treated_only",
             "mean_dose_attributable_points"], "s1"),
        tidy("decomposition_by_severity", "\"window\" || '/' || band", ["n", "pct_dose_determined"], "s2"),
        tidy("window_audit", "''", ["pct_gt50_before", "pct_gt50_after", "residual_after_correction"], "s3"),
        tidy("cohort", "''", ["n_entities", "n_rows", "positive_rate"], "s4"),
    ]), [("s1", _SUMMARY), ("s2", _BANDED), ("s3", _BEFORE_AFTER), ("s4", _PREVALENCE)])
    return out
