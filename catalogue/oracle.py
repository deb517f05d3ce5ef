"""DuckDB SQL for the queries, written independently of the Spark code.

Shared parts are common table expressions; ``_sql`` puts those a query names in front of it.
"""

from __future__ import annotations

PARTS = {
    "tx": """tx AS (
  SELECT e.event_id AS transaction_id, e.user_id, CAST(round(e.value * 250, 2) AS DECIMAL(12,2)) AS amount,
    'USD' AS currency, s.s_name AS merchant_name,
    CASE e.event_type WHEN 'purchase' THEN 'retail' WHEN 'click' THEN 'electronics' WHEN 'view' THEN 'travel'
      WHEN 'signup' THEN 'gambling' WHEN 'error' THEN 'cryptocurrency' END AS merchant_category,
    lpad(CAST(e.k % 30 AS VARCHAR), 4, '0') AS card_last4, e.ts, e.ts AS created_at, e.k,
    CASE WHEN e.event_type = 'error' THEN 1 ELSE 0 END AS is_fraud,
    h.n_name AS home_country, CASE WHEN e.k < 80 THEN h.n_name ELSE a.n_name END AS country
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e
  LEFT JOIN supplier s ON s.s_suppkey = e.event_id % (SELECT max(s_suppkey) + 1 FROM supplier)
  LEFT JOIN customer c ON c.c_custkey = e.user_id
  LEFT JOIN nation h ON h.n_nationkey = c.c_nationkey
  LEFT JOIN nation a ON a.n_nationkey = e.k % 25)""",
    "cards": """cards AS (
  SELECT DISTINCT user_id, card_last4 FROM tx WHERE ts < TIMESTAMP '2024-01-16 00:00:00')""",
    "ctx": """ctx AS (
  SELECT tx.*,
    count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 5 MINUTES PRECEDING AND CURRENT ROW) AS n_5min,
    count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n_1h,
    count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 12 HOURS PRECEDING AND CURRENT ROW) AS n_12h,
    lower(merchant_name) IN (SELECT lower(s_name) FROM supplier WHERE s_acctbal < 1000) AS listed,
    user_id IN (SELECT user_id FROM cards) AND (user_id, card_last4) NOT IN (SELECT (user_id, card_last4) FROM cards) AS odd_card
  FROM tx)""",
    "flags": """flags AS (
  SELECT ctx.*, amount > 5000 AS high_amount, n_12h > 3 AS high_velocity, listed AS unusual_merchant,
    odd_card AS card_mismatch, hour(ts) < 6 AS unusual_hours, country <> home_country AS country_mismatch
  FROM ctx)""",
    "flags5": """flags5 AS (SELECT * REPLACE (n_5min > 3 AS high_velocity) FROM flags)""",
}
_LIST = """concat_ws(',', CASE WHEN high_amount THEN 'high_amount' END, CASE WHEN high_velocity THEN 'high_velocity' END,
      CASE WHEN unusual_merchant THEN 'unusual_merchant' END, CASE WHEN card_mismatch THEN 'card_mismatch' END,
      CASE WHEN unusual_hours THEN 'unusual_hours' END, CASE WHEN country_mismatch THEN 'country_mismatch' END)"""
_RULES = """CAST(least(100, 30 * high_amount::INT + 25 * high_velocity::INT + 20 * unusual_merchant::INT
      + 20 * card_mismatch::INT + 10 * unusual_hours::INT + 15 * country_mismatch::INT) AS DOUBLE)"""
_TIER = """CASE WHEN {a} BETWEEN 0 AND 1000 THEN 70 WHEN {a} BETWEEN 1001 AND 10000 THEN 60
      WHEN {a} BETWEEN 10001 AND 50000 THEN 50 WHEN {a} >= 50001 THEN 40 ELSE 70 END::DOUBLE"""
_LADDER = """CASE WHEN {a} <= 1000 THEN 70 WHEN {a} <= 10000 THEN 60 WHEN {a} <= 50000 THEN 50 ELSE 40 END::DOUBLE"""
_LABEL = """CASE WHEN {a} BETWEEN 0 AND 1000 THEN 'low' WHEN {a} BETWEEN 1001 AND 10000 THEN 'medium'
      WHEN {a} BETWEEN 10001 AND 50000 THEN 'high' WHEN {a} >= 50001 THEN 'critical' ELSE 'none' END"""


def _scored(name: str, flags: str, score: str, limit: str = _TIER) -> str:
    return f"""{name} AS (
  SELECT *, CASE WHEN ensemble_score > threshold THEN 'fraud' WHEN ensemble_score = threshold THEN 'review'
      ELSE 'legitimate' END AS classification,
    CASE WHEN ensemble_score > threshold THEN 'blocked' WHEN ensemble_score = threshold THEN 'flagged'
      ELSE 'approved' END AS status
  FROM (SELECT *, {score} AS ensemble_score, {limit.format(a="amount")} AS threshold, 0::DOUBLE AS ml_score
    FROM (SELECT *, {_RULES} AS rule_score, {_LIST} AS fired_rules FROM {flags})))"""


PARTS["scored"] = _scored("scored", "flags", "least(100::DOUBLE, rule_score)")
PARTS["scored5"] = _scored("scored5", "flags5", "rule_score * 0.45::DOUBLE")
PARTS["scoredd"] = _scored("scoredd", "flags", "rule_score * 0.45::DOUBLE")
PARTS["scoredc"] = _scored("scoredc", "flags", "rule_score", _LADDER)
PARTS["stored"] = """stored AS (
  SELECT *, CASE WHEN transaction_id % 20 = 7 THEN TIMESTAMP '2024-02-01 00:00:00' END AS deleted_at FROM scored)"""
PARTS["alerts"] = """alerts AS (
  SELECT 'alert-' || transaction_id AS alert_id, transaction_id, 'open' AS status, ensemble_score AS score, threshold,
    classification, created_at FROM scored WHERE classification = 'fraud')"""
PARTS["actions"] = """actions AS (
  SELECT alert_id || '-' || i AS action_id, alert_id, transaction_id,
    ['review', 'false_positive', 'revert'][CAST((transaction_id + i) % 3 + 1 AS INTEGER)] AS action,
    'analyst-' || (transaction_id % 7) AS analyst_id,
    CASE WHEN (transaction_id + i) % 2 = 0 THEN 'checked "' || i || '"' END AS reason,
    created_at + i * INTERVAL 1 HOUR AS acted_at
  FROM alerts, (SELECT unnest([1, 2, 3]) AS i) WHERE i <= transaction_id % 4)"""
_AFTER = "CASE {a} WHEN 'review' THEN 'reviewed' WHEN 'false_positive' THEN 'resolved' WHEN 'revert' THEN 'open' END"
PARTS["moves"] = f"""moves AS (
  SELECT *, coalesce({_AFTER.format(a="lag(action) OVER (PARTITION BY alert_id ORDER BY acted_at, action_id)")}, 'open')
    AS previous_status, {_AFTER.format(a="action")} AS new_status FROM actions)"""
PARTS["reports"] = """reports AS (
  SELECT *, CASE WHEN status = 'failed' AND retry_count >= 3 THEN 'timeout' END AS error FROM (
    SELECT *, CASE WHEN report_text IS NULL THEN 'pending' WHEN report_text LIKE 'Error:%' THEN 'failed'
      ELSE 'completed' END AS status FROM (
      SELECT transaction_id, CASE WHEN transaction_id % 5 = 1 THEN 'Error: timeout'
          WHEN transaction_id % 5 = 2 THEN 'Error inesperado: timeout'
          WHEN transaction_id % 5 > 2 THEN 'Informe ' || transaction_id END AS report_text,
        'local-model' AS model_name,
        CASE WHEN transaction_id % 5 > 2 THEN CAST(transaction_id % 1000 AS INTEGER) END AS generation_time_ms,
        CAST(transaction_id % 4 AS INTEGER) AS retry_count, created_at + INTERVAL 1 MINUTE AS created_at
      FROM scored WHERE classification = 'fraud' AND transaction_id % 3 <> 0)))"""
_ENTRY = "action_type, transaction_id, user_id, previous_status, new_status, details, sha256_checksum, created_at"


def _audit(name: str, rows: str) -> str:
    return f"""{name} AS (
  SELECT *, sha256('{{' || concat_ws(', ', '"action_type": "' || action_type || '"', '"details": ' || details,
      '"new_status": "' || new_status || '"', '"previous_status": "' || previous_status || '"',
      '"transaction_id": "' || transaction_id || '"', '"user_id": "' || user_id || '"') || '}}') AS sha256_checksum
  FROM ({rows}))"""


PARTS["audit_s"] = _audit(
    "audit_s",
    """SELECT 'transaction_scored' AS action_type, CAST(transaction_id AS VARCHAR) AS transaction_id,
    CAST(user_id AS VARCHAR) AS user_id, CAST(NULL AS VARCHAR) AS previous_status, CAST(NULL AS VARCHAR) AS new_status,
    '{"classification": "' || classification || '", "ensemble_score": ' || ensemble_score || ', "fired_rules": ['
      || CASE WHEN fired_rules = '' THEN '' ELSE '"' || replace(fired_rules, ',', '", "') || '"' END
      || '], "ml_score": ' || ml_score || ', "rule_score": ' || rule_score || ', "threshold": ' || threshold || '}' AS details,
    created_at FROM scored""",
)
PARTS["audit_a"] = _audit(
    "audit_a",
    """SELECT action AS action_type, CAST(transaction_id AS VARCHAR) AS transaction_id, analyst_id AS user_id,
    previous_status, new_status, '{"alert_id": "' || alert_id || '", "reason": '
      || coalesce('"' || replace(reason, '"', '\\"') || '"', 'null') || '}' AS details, acted_at AS created_at FROM moves""",
)
PARTS["audit_r"] = _audit(
    "audit_r",
    """SELECT CASE WHEN status = 'failed' THEN 'report_failed' ELSE 'report_generated' END AS action_type,
    CAST(transaction_id AS VARCHAR) AS transaction_id, CAST(NULL AS VARCHAR) AS user_id,
    CAST(NULL AS VARCHAR) AS previous_status, CAST(NULL AS VARCHAR) AS new_status,
    CASE WHEN error IS NOT NULL THEN '{"error": "' || error || '", '
      ELSE '{"generation_time_ms": ' || coalesce(CAST(generation_time_ms AS VARCHAR), 'null') || ', ' END
      || '"model": "' || model_name || '", "retry_count": ' || retry_count || ', "status": "' || status || '"}' AS details,
    created_at FROM reports WHERE status <> 'pending'""",
)
PARTS["trail"] = f"""trail AS (
  SELECT {_ENTRY} FROM audit_s UNION ALL SELECT {_ENTRY} FROM audit_a UNION ALL SELECT {_ENTRY} FROM audit_r)"""


def _exact(x: str, digits: int) -> str:
    return f"CAST(printf('%.{digits}f', CAST({x} AS DOUBLE)) AS DOUBLE)"


def _metrics(source: str) -> str:
    values = {
        "precision": "CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END",
        "recall": "CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END",
        "f1": "CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE (2 * tp)::DOUBLE / (2 * tp + fp + fn) END",
        "auc_roc": "CASE WHEN tp + fn = 0 OR tn + fp = 0 THEN 0 ELSE (tp::DOUBLE / (tp + fn) + tn::DOUBLE / (tn + fp)) / 2 END",
    }
    return f"SELECT *, {', '.join(f'{_exact(value, 4)} AS {name}' for name, value in values.items())} FROM {source}"


_COUNTS = """count(*) FILTER (WHERE p AND a) AS tp, count(*) FILTER (WHERE p AND NOT a) AS fp,
    count(*) FILTER (WHERE NOT p AND NOT a) AS tn, count(*) FILTER (WHERE NOT p AND a) AS fn"""
PARTS["pairs"] = "pairs AS (SELECT quality = 1 AS p, toxic = 0 AS a FROM labels)"
PARTS["daily"] = f"""daily AS ({_metrics(f'''(SELECT CAST(ts AS DATE) AS day, {_COUNTS}
    FROM (SELECT ts, classification = 'fraud' AS p, is_fraud = 1 AS a FROM scored) GROUP BY 1)''')})"""
PARTS["runs"] = """runs AS (
  SELECT 'v' || strftime(day, '%Y-%m-%d') AS model_version, "precision", recall, f1,
    CASE WHEN f1 > 0.15 THEN 'ready' ELSE 'failed' END AS status, fp > tp * 5 AS drift_detected,
    CAST(day AS TIMESTAMP) AS created_at FROM daily)"""
PARTS["history"] = """history AS (
  SELECT user_id, CAST(sum(amount) AS DOUBLE) / count(*) AS avg_amount, stddev_pop(CAST(amount AS DOUBLE)) AS std_amount,
    count(*) AS n_transactions FROM tx WHERE {where} GROUP BY 1)"""
PARTS["fitted"] = PARTS["history"].format(where="is_fraud = 0")
PARTS["early"] = PARTS["history"].format(where="is_fraud = 0 AND ts < TIMESTAMP '2024-01-16 00:00:00'")
PARTS["features"] = """features AS (
  SELECT transaction_id, ts, is_fraud, CAST(amount AS DOUBLE) AS f_amount,
    CASE WHEN avg_amount > 0 THEN CAST(amount AS DOUBLE) / avg_amount - 1 ELSE 0 END AS f_amount_vs_user_avg,
    CASE WHEN std_amount > 0 THEN (CAST(amount AS DOUBLE) - avg_amount) / std_amount ELSE 0 END AS f_amount_vs_user_std,
    CAST(n_5min AS DOUBLE) AS f_tx_count_last_5min, CAST(n_1h AS DOUBLE) AS f_tx_count_last_1h,
    CAST(hour(ts) AS DOUBLE) AS f_hour_of_day, CAST(isodow(ts) >= 6 AS INTEGER)::DOUBLE AS f_is_weekend,
    CAST(merchant_category IN ('cryptocurrency', 'money_transfer', 'gambling', 'adult', 'pharmacy') AS INTEGER)::DOUBLE
      AS f_merchant_risk_level, CAST(merchant_category = 'cryptocurrency' AS INTEGER)::DOUBLE AS f_is_crypto,
    CAST(amount > 0 AND amount % 100 = 0 AS INTEGER)::DOUBLE AS f_amount_round_number
  FROM ctx LEFT JOIN history USING (user_id))"""
FEATURES = (
    "f_amount f_amount_vs_user_avg f_amount_vs_user_std f_tx_count_last_5min f_tx_count_last_1h f_hour_of_day "
    "f_is_weekend f_merchant_risk_level f_is_crypto f_amount_round_number"
).split()

NEEDS = {
    "cards": ["tx"],
    "ctx": ["tx", "cards"],
    "flags": ["ctx"],
    "flags5": ["flags"],
    "scored": ["flags"],
    "scored5": ["flags5"],
    "scoredd": ["flags"],
    "scoredc": ["flags"],
    "stored": ["scored"],
    "alerts": ["scored"],
    "actions": ["alerts"],
    "moves": ["actions"],
    "reports": ["scored"],
    "audit_s": ["scored"],
    "audit_a": ["moves"],
    "audit_r": ["reports"],
    "trail": ["audit_s", "audit_a", "audit_r"],
    "daily": ["scored"],
    "runs": ["daily"],
    "fitted": ["tx"],
    "early": ["tx"],
    "features": ["ctx", "fitted"],
}


def _sql(parts: str, body: str, extra: str = "") -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in order:
            order.append(name)

    for name in parts.split():
        add(name)
    ctes = [PARTS[name] for name in order] + ([extra] if extra else [])
    return f"WITH {', '.join(ctes)} {body}" if ctes else body


def _drift(pairs: str) -> str:
    """CTEs from ``pairs(feature, is_reference, value)`` to ``psi`` per feature."""
    edges = " + ".join(f"CAST(value >= lo + (hi - lo) / 10 * {i} AS INTEGER)" for i in range(1, 10))
    return f"""{pairs},
  stats AS (SELECT feature, min(value) AS lo, max(value) AS hi,
    count(*) FILTER (WHERE is_reference) AS n_reference, count(*) FILTER (WHERE NOT is_reference) AS n_current,
    avg(value) FILTER (WHERE is_reference) AS mean_reference, avg(value) FILTER (WHERE NOT is_reference) AS mean_current
    FROM pairs_fd GROUP BY 1),
  bins AS (SELECT feature, {edges} AS bin, count(*) FILTER (WHERE is_reference) AS in_reference,
    count(*) FILTER (WHERE NOT is_reference) AS in_current FROM pairs_fd JOIN stats USING (feature) GROUP BY 1, 2),
  spine AS (SELECT feature, i AS bin FROM stats, (SELECT unnest(range(10)) AS i)),
  shares AS (SELECT feature, bin, coalesce(in_reference, 0) / n_reference + 1e-10 AS p,
    coalesce(in_current, 0) / n_current + 1e-10 AS q FROM spine LEFT JOIN bins USING (feature, bin) JOIN stats USING (feature)),
  psi AS (SELECT feature, CASE WHEN lo = hi THEN 0 ELSE sum((p - q) * ln(p / q)) END AS psi FROM shares
    JOIN stats USING (feature) GROUP BY feature, lo, hi),
  found AS (SELECT *, least(psi * 10, 100) AS score FROM psi JOIN stats USING (feature))"""


_HALVES = """pairs_fd AS (SELECT 'value' AS feature, ts < TIMESTAMP '2024-01-16 00:00:00' AS is_reference,
  CAST(amount AS DOUBLE) AS value FROM tx)"""
_LONG = f"""pairs_fd AS (SELECT feature, ts < TIMESTAMP '2024-01-16 00:00:00' AS is_reference, value FROM features
  UNPIVOT (value FOR feature IN ({', '.join(FEATURES)})))"""


def _report(digits: int) -> str:
    return f"""SELECT round(psi, {digits}) AS psi, {_exact('score', 2)} AS drift_score, score > 30 AS drift_detected,
  {_exact('mean_reference', 4)} AS reference_mean, {_exact('mean_current', 4)} AS current_mean,
  {_exact('mean_current - mean_reference', 4)} AS shift FROM found"""


_PER_FEATURE = f"""per_feature AS (SELECT feature, {_exact('psi', 4)} AS psi, {_exact('mean_reference', 4)} AS reference_mean,
  {_exact('mean_current', 4)} AS current_mean, {_exact('score', 2)} AS drift_score, score > 0.005 AS drift_detected FROM found)"""
_RECENT = """recent AS (SELECT ensemble_score AS value, row_number() OVER (ORDER BY created_at DESC, transaction_id DESC) AS place
  FROM scoredd QUALIFY place <= 200)"""
_FLAT = "transaction_id, rule_score, ml_score, ensemble_score, threshold, classification, status, fired_rules"
_SPLIT = "TIMESTAMP '2024-01-16 00:00:00'"


def _areas(pairs: str) -> str:
    return f"""g AS (SELECT score, count(*) FILTER (WHERE actual = 1) AS pos, count(*) FILTER (WHERE actual = 0) AS neg
    FROM ({pairs}) GROUP BY 1),
  c AS (SELECT *, coalesce(sum(pos) OVER b, 0) AS pos_below, coalesce(sum(neg) OVER b, 0) AS neg_below,
    sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
    sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM g
    WINDOW b AS (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  r AS (SELECT *, tp / np AS recall, tp / (tp + fp) AS prec FROM c),
  s AS (SELECT *, lag(recall, 1, 0) OVER (ORDER BY score DESC) AS recall0, lag(prec, 1, 1) OVER (ORDER BY score DESC) AS prec0 FROM r)"""


_AREA = """SELECT round(CAST(sum(pos * (neg_below + neg / 2)) AS DOUBLE) / max(np) / max(nn), 6) AS roc_auc,
  round(sum((recall - recall0) * (prec + prec0) / 2), 6) AS pr_auc FROM s"""
_WRONG = """CASE WHEN previous_status <> CASE action WHEN 'revert' THEN 'reviewed' ELSE 'open' END THEN 'illegal_transition' END,
  CASE WHEN action = 'false_positive' AND coalesce(trim(reason), '') = '' THEN 'missing_reason' END"""
_BUCKETS = [("0-20", 0, 20), ("21-40", 21, 40), ("41-60", 41, 60), ("61-80", 61, 80), ("81-100", 81, 100)]


def _histogram(contiguous: bool) -> str:
    rows, previous = [], None
    for label, low, high in _BUCKETS:
        start = f"> {previous}" if contiguous and previous is not None else f">= {low}"
        condition = f"ensemble_score {start} AND ensemble_score <= {high}"
        rows.append(f"SELECT '{label}' AS \"range\", count(*) FILTER (WHERE {condition}) AS \"count\" FROM scoredd")
        previous = high
    return " UNION ALL ".join(rows)


_FAULTY = """faulty AS (SELECT transaction_id, user_id,
  CASE WHEN transaction_id % 11 = 0 THEN 0 ELSE amount END AS amount,
  CASE WHEN transaction_id % 13 = 0 THEN 'US' ELSE currency END AS currency,
  CASE WHEN transaction_id % 17 = 0 THEN '' ELSE merchant_name END AS merchant_name,
  CASE WHEN transaction_id % 19 = 0 THEN '123' ELSE card_last4 END AS card_last4,
  CASE WHEN transaction_id % 23 = 0 THEN repeat('x', 101) ELSE merchant_category END AS merchant_category FROM tx),
checked AS (SELECT *, concat_ws(',', CASE WHEN amount > 0 THEN NULL ELSE 'amount' END,
  CASE WHEN length(currency) <> 3 THEN 'currency' END,
  CASE WHEN length(merchant_name) NOT BETWEEN 1 AND 255 THEN 'merchant_name' END,
  CASE WHEN length(merchant_category) > 100 THEN 'merchant_category' END,
  CASE WHEN length(card_last4) <> 4 THEN 'card_last4' END) AS reasons FROM faulty)"""
_FLAGGED = """flagged AS (SELECT * FROM stored WHERE deleted_at IS NULL AND status = 'flagged'
  AND created_at BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00')"""
_PROMPT = """'Explica en español, para personal técnico, la puntuación de una operación que ya tiene su clase.
Datos: id=' || transaction_id || '; importe=' || CAST(amount AS DOUBLE) || ' ' || currency || '; comercio=' || merchant_name || '
Puntos: reglas=' || printf('%.1f', rule_score) || '; anomalía=' || printf('%.1f', ml_score) || '; conjunto='
  || printf('%.1f', ensemble_score) || '; límite=' || printf('%.1f', threshold) || '
Señales:
' || CASE WHEN fired_rules = '' THEN '- Ninguna regla activada'
  ELSE '- ' || replace(fired_rules, ',', chr(10) || '- ') END || '
Usa los títulos Justificación del riesgo / Recomendación técnica / Factores contextuales, cita solo estos datos y no repitas ni discutas la clase.'"""
_REASONS = "concat_ws(',', CASE WHEN n >= 3 THEN 'data_drift' END, CASE WHEN f1 < 0.7 THEN 'performance_degradation' END)"
_COMBINE = "greatest(0::DOUBLE, least(100::DOUBLE, rule * {r}::DOUBLE + ml * {m}::DOUBLE + place * {c}::DOUBLE))"



ORACLE = {
    "rule_flags": _sql(
        "flags",
        """SELECT transaction_id, high_amount, high_velocity, unusual_merchant, card_mismatch, unusual_hours,
  country_mismatch FROM flags""",
    ),
    "rule_scores": _sql("scored", "SELECT transaction_id, rule_score, fired_rules FROM scored"),
    "rule_hit_counts": _sql(
        "flags",
        """SELECT rule, count(*) AS n_hits FROM flags UNPIVOT (hit FOR rule IN (high_amount, high_velocity,
  unusual_merchant, card_mismatch, unusual_hours, country_mismatch)) WHERE hit GROUP BY 1""",
    ),
    "rules_weighted_table": _sql(
        "flags",
        """SELECT transaction_id, CAST(least(100, 40 * high_amount::INT + 35 * unusual_merchant::INT + 5 * unusual_hours::INT
    + 45 * country_mismatch::INT) AS DOUBLE) AS rule_score,
  concat_ws(',', CASE WHEN high_amount THEN 'high_amount' END, CASE WHEN unusual_merchant THEN 'unusual_merchant' END,
    CASE WHEN unusual_hours THEN 'unusual_hours' END, CASE WHEN country_mismatch THEN 'country_mismatch' END) AS fired_rules
  FROM flags""",
    ),
    "blacklisted_merchants": _sql(
        "ctx", "SELECT merchant_name, listed AS merchant_listed, count(*) AS n_transactions FROM ctx GROUP BY 1, 2"
    ),
    "velocity_5m": _sql("ctx", "SELECT transaction_id, n_5min AS n FROM ctx"),
    "velocity_1h": _sql("ctx", "SELECT transaction_id, n_1h AS n FROM ctx"),
    "velocity_12h_burst": _sql("ctx", "SELECT transaction_id, user_id, n_12h AS n FROM ctx WHERE n_12h > 3"),
    "velocity_hot_users": _sql("ctx", "SELECT transaction_id, n_1h, n_12h FROM ctx"),
    "known_cards": _sql("cards", "SELECT user_id, card_last4 FROM cards"),
    "home_country": """SELECT c_custkey AS user_id, n_name AS home_country FROM customer
  LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "user_history": _sql(
        "fitted",
        "SELECT user_id, n_transactions, round(avg_amount, 6) AS avg_amount, round(std_amount, 6) AS std_amount FROM history",
    ),
    "attached_history": _sql(
        "early",
        """SELECT transaction_id, round(coalesce(avg_amount, 0), 6) AS avg_amount, round(coalesce(std_amount, 0), 6) AS std_amount
  FROM tx LEFT JOIN history USING (user_id)""",
    ),
    "history_prior": _sql(
        "tx",
        """SELECT transaction_id, count(*) OVER w AS prior_count,
  round(coalesce(avg(CAST(amount AS DOUBLE)) OVER w, 0), 6) AS prior_avg_amount,
  round(coalesce(stddev_pop(CAST(amount AS DOUBLE)) OVER w, 0), 6) AS prior_std_amount FROM tx
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    ),
    "features": _sql(
        "features", f"SELECT transaction_id, {', '.join(f'round({f}, 6) AS {f}' for f in FEATURES)} FROM features"
    ),
    "feature_vectors": _sql(
        "features",
        "SELECT transaction_id, concat_ws(',', "
        + ", ".join(f"printf('%.3f', round({f}, 6))" for f in FEATURES)
        + ") AS vector FROM features",
    ),
    "threshold_tiers": f"""SELECT o_orderkey, {_TIER.format(a='o_totalprice')} AS threshold,
  {_LADDER.format(a='o_totalprice')} AS threshold_contiguous, {_LABEL.format(a='o_totalprice')} AS tier FROM orders""",
    "ensemble_grid": f"""WITH g AS (SELECT o_orderkey, CAST(floor(o_totalprice) % 101 AS DOUBLE) AS rule,
    CAST(o_orderkey % 101 AS DOUBLE) AS ml, CAST(o_custkey % 101 AS DOUBLE) AS place FROM orders),
  w AS (SELECT o_orderkey, {_COMBINE.format(r='0.45', m='0.45', c='0')} AS standard,
    {_COMBINE.format(r='0.4', m='0.6', c='0')} AS two_layers, {_COMBINE.format(r='0.4', m='0.4', c='0.2')} AS three_layers,
    {_COMBINE.format(r='0.6', m='0.6', c='0')} AS capped, {_COMBINE.format(r='(-0.5)', m='0.25', c='0')} AS floored,
    {_COMBINE.format(r='0.5', m='0.5', c='0')} AS halves FROM g)
  SELECT o_orderkey, standard, two_layers, three_layers, capped, floored,
    CASE WHEN halves > 50 THEN 'fraud' WHEN halves = 50 THEN 'review' ELSE 'legitimate' END AS classification FROM w""",
    "scored_transactions": _sql("scored", f"SELECT {_FLAT} FROM scored"),
    "scored_transactions_default": _sql("scored5", f"SELECT {_FLAT} FROM scored5"),
    "scored_transactions_contiguous": _sql("scoredc", f"SELECT {_FLAT} FROM scoredc"),
    "alerts": _sql("alerts", "SELECT alert_id, transaction_id, status, score, threshold, classification, created_at FROM alerts"),
    "status_rollup": _sql(
        "scored",
        "SELECT status, classification, count(*) AS n_transactions, status AS expected_status FROM scored GROUP BY 1, 2",
    ),
    "class_by_tier": _sql(
        "scored",
        f"SELECT {_LABEL.format(a='amount')} AS tier, classification, count(*) AS n_transactions FROM scored GROUP BY 1, 2",
    ),
    "status_and_band": _sql(
        "scored",
        """SELECT transaction_id, classification, CASE WHEN ensemble_score > 70 THEN 'high' WHEN ensemble_score > 40 THEN 'medium'
  ELSE 'low' END AS band FROM scored""",
    ),
    "table_scan": "SELECT c_mktsegment, count(*) AS n_users FROM customer GROUP BY 1",
    "valid_rejects": _sql("tx", "SELECT transaction_id, reasons FROM checked WHERE reasons <> ''", _FAULTY),
    "valid_rows": _sql("tx", "SELECT transaction_id, CAST(amount AS DOUBLE) AS amount FROM checked WHERE reasons = ''", _FAULTY),
    "live_transactions": _sql("stored", "SELECT transaction_id, status FROM stored WHERE deleted_at IS NULL"),
    "soft_deletion": _sql(
        "stored",
        """SELECT transaction_id, CASE WHEN deleted_at IS NULL AND classification = 'fraud' THEN TIMESTAMP '2024-02-02 00:00:00'
  ELSE deleted_at END AS deleted_at FROM stored""",
    ),
    "filtered_page": _sql(
        "stored",
        "SELECT transaction_id, status, created_at FROM flagged ORDER BY created_at DESC, transaction_id LIMIT 20 OFFSET 20",
        _FLAGGED,
    ),
    "filtered_page_after": _sql(
        "stored",
        """SELECT transaction_id, created_at FROM flagged WHERE created_at < TIMESTAMP '2024-01-20 00:00:00'
  ORDER BY created_at DESC, transaction_id LIMIT 50""",
        _FLAGGED,
    ),
    "filtered_total": _sql("stored", "SELECT count(*) AS total FROM flagged", _FLAGGED),
    "user_transactions": _sql(
        "stored", "SELECT transaction_id, user_id, status FROM stored WHERE user_id = 7 AND deleted_at IS NULL"
    ),
    "point_lookup": _sql("stored", "SELECT transaction_id, status, deleted_at FROM stored WHERE transaction_id = 27"),
    "alert_page": _sql(
        "alerts",
        """SELECT alert_id, score, created_at FROM alerts WHERE status = 'open' AND created_at BETWEEN
  TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-28 00:00:00' ORDER BY created_at DESC, alert_id LIMIT 100""",
    ),
    "sorted_transactions": _sql(
        "scored",
        """SELECT transaction_id, CASE WHEN transaction_id % 9 <> 0 THEN ensemble_score END AS risk_score FROM scored
  ORDER BY risk_score DESC NULLS LAST, transaction_id""",
    ),
    "transaction_list": _sql(
        "scored",
        """SELECT transaction_id AS id, CAST(amount AS DOUBLE) AS amount, currency, merchant_name, merchant_category, card_last4,
  status, ensemble_score AS risk_score, user_id, created_at FROM scored""",
    ),
    "alert_list": _sql(
        "alerts", "SELECT alert_id AS id, transaction_id, status, score, threshold, classification, created_at FROM alerts"
    ),
    "alert_fold": _sql(
        "actions",
        f"""SELECT a.alert_id, coalesce({_AFTER.format(a='l.action')}, a.status) AS status, l.analyst_id AS reviewed_by,
  l.acted_at AS reviewed_at FROM alerts a LEFT JOIN (SELECT * FROM actions
    QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY acted_at DESC, action_id DESC) = 1) l USING (alert_id)""",
    ),
    "alert_transitions": _sql("moves", "SELECT action_id, transaction_id, action, previous_status, new_status FROM moves"),
    "alert_illegal": _sql(
        "moves",
        f"""SELECT action_id, problems FROM (SELECT action_id, concat_ws(',', {_WRONG}) AS problems FROM moves)
  WHERE problems <> ''""",
    ),
    "dashboard_kpis": _sql(
        "stored alerts runs",
        f"""SELECT (SELECT count(*) FROM stored WHERE deleted_at IS NULL) AS total_transactions,
  {_exact("(SELECT count(*) FILTER (WHERE status = 'blocked') / count(*) * 100 FROM stored WHERE deleted_at IS NULL)", 2)}
    AS fraud_percentage, {_exact('(SELECT avg(ensemble_score) FROM stored)', 2)} AS avg_score,
  (SELECT count(*) FROM alerts) AS active_alerts,
  (SELECT status FROM runs ORDER BY created_at DESC LIMIT 1) AS model_status""",
    ),
    "score_histogram": _sql("scoredd", _histogram(False)),
    "score_histogram_contiguous": _sql("scoredd", _histogram(True)),
    "score_trend": _sql(
        "scored",
        """SELECT strftime(d, '%Y-%m-%d') AS date, coalesce(floor(avg(ensemble_score) * 10 + 0.5) / 10, 0) AS avg_score
  FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-24', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS d)
  LEFT JOIN (SELECT * FROM scored WHERE ensemble_score <> 0 AND created_at >= TIMESTAMP '2024-01-23 12:00:00') x
    ON CAST(x.created_at AS DATE) = d GROUP BY d""",
    ),
    "tx_per_day": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_transactions FROM events GROUP BY 1",
    "alerts_per_rule": _sql(
        "scored",
        """SELECT rule, count(*) AS n_alerts FROM (SELECT unnest(string_split(fired_rules, ',')) AS rule FROM scored
  WHERE classification = 'fraud') GROUP BY 1""",
    ),
    "fraud_by_country": _sql(
        "scored",
        """SELECT country, count(*) AS n_transactions, count(*) FILTER (WHERE classification = 'fraud') AS n_fraud
  FROM scored GROUP BY 1""",
    ),
    "transactions_with_score": _sql(
        "scored",
        """SELECT transaction_id, CAST(amount AS DOUBLE) AS amount,
  CASE WHEN transaction_id % 9 <> 0 THEN ensemble_score END AS ensemble_score,
  CASE WHEN transaction_id % 9 <> 0 THEN classification END AS classification FROM scored""",
    ),
    "transaction_detail": _sql(
        "scored reports trail",
        """SELECT s.transaction_id, rule_score, ensemble_score, classification, r.status AS report_status,
  t.action_type AS entry_action, t.created_at AS entry_at, t.sha256_checksum AS entry_checksum
  FROM scored s LEFT JOIN reports r USING (transaction_id) LEFT JOIN trail t ON t.transaction_id = CAST(s.transaction_id AS VARCHAR)""",
    ),
    "audit_scoring": _sql("audit_s", f"SELECT {_ENTRY} FROM audit_s"),
    "audit_actions": _sql("audit_a", f"SELECT {_ENTRY} FROM audit_a"),
    "audit_reports": _sql("audit_r", f"SELECT {_ENTRY} FROM audit_r"),
    "audit_trail": _sql("trail", f"SELECT {_ENTRY} FROM trail WHERE transaction_id = '103' ORDER BY created_at"),
    "audit_chains": _sql(
        "trail",
        """SELECT transaction_id, row_number() OVER (PARTITION BY transaction_id ORDER BY created_at, sha256_checksum) AS step,
  action_type, sha256_checksum FROM trail""",
    ),
    "audit_by_analyst": _sql("trail", f"SELECT {_ENTRY} FROM trail WHERE user_id = 'analyst-3' ORDER BY created_at"),
    "audit_verify": _sql(
        "audit_s",
        """SELECT transaction_id, replace(details, '"ml_score": 0.0', '"ml_score": 9.0') AS details FROM audit_s
  WHERE CAST(transaction_id AS BIGINT) % 10 = 3""",
    ),
    "audit_export": _sql(
        "trail",
        f"""SELECT {_ENTRY} FROM trail WHERE created_at BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'""",
    ),
    "confusion": _sql("pairs", f"SELECT {_COUNTS} FROM pairs"),
    "binary_metrics": _sql("pairs", _metrics(f"(SELECT {_COUNTS} FROM pairs)")),
    "daily_metrics": _sql("daily", "SELECT * REPLACE (strftime(day, '%Y-%m-%d') AS day) FROM daily"),
    "curve_areas": _sql("scored", _AREA, _areas("SELECT rule_score AS score, is_fraud AS actual FROM scored")),
    "curve_areas_continuous": _sql("tx", _AREA, _areas("SELECT CAST(amount AS DOUBLE) AS score, is_fraud AS actual FROM tx")),
    "score_curve": _sql(
        "scored",
        "SELECT score, pos, neg, CAST(tp - pos AS BIGINT) AS pos_above, CAST(fp - neg AS BIGINT) AS neg_above FROM c",
        _areas("SELECT rule_score AS score, is_fraud AS actual FROM scored"),
    ),
    "psi_value": _sql("tx", "SELECT n_reference, n_current, round(psi, 9) AS psi FROM found", _drift(_HALVES)),
    "psi_histogram": _sql("tx", "SELECT bin, in_reference, in_current FROM bins", _drift(_HALVES)),
    "psi_edges": _sql(
        "tx",
        """SELECT i, round(CASE WHEN i = 10 THEN hi ELSE lo + (hi - lo) / 10 * i END, 6) AS edge
  FROM stats, (SELECT CAST(unnest(range(11)) AS INTEGER) AS i)""",
        _drift(_HALVES),
    ),
    "drift_report": _sql("tx", _report(9), _drift(_HALVES)),
    "feature_drift": _sql("features", "SELECT * FROM per_feature", f"{_drift(_LONG)}, {_PER_FEATURE}"),
    "drift_recent": _sql(
        "scoredd",
        _report(6),
        _drift(f"{_RECENT}, pairs_fd AS (SELECT 'value' AS feature, place > 100 AS is_reference, value FROM recent)"),
    ),
    "drift_recent_reference": _sql(
        "scoredd",
        _report(6),
        _drift(
            f"""{_RECENT}, pairs_fd AS (SELECT 'value' AS feature, false AS is_reference, value FROM recent WHERE place <= 100
  UNION ALL SELECT 'value', true, ensemble_score FROM scoredd WHERE ts < {_SPLIT})"""
        ),
    ),
    "retraining": _sql(
        "daily", "SELECT strftime(day, '%Y-%m-%d') AS day, f1, f1 < 0.7 OR fp > 30 AS retrain FROM daily"
    ),
    "retraining_recommendation": _sql(
        "features pairs",
        f"""SELECT n AS drifted_features, f1, {_REASONS} AS reasons, n >= 3 OR f1 < 0.7 AS recommended,
  CASE WHEN f1 < 0.7 THEN 'degraded' ELSE 'ready' END AS run_status
  FROM (SELECT count(*) FILTER (WHERE drift_detected) AS n FROM per_feature), ({_metrics(f'(SELECT {_COUNTS} FROM pairs)')})""",
        f"{_drift(_LONG)}, {_PER_FEATURE}",
    ),
    "model_runs": _sql("runs", "SELECT * FROM runs ORDER BY created_at DESC LIMIT 20"),
    "latest_model_run": _sql("runs", "SELECT status AS model_status FROM runs ORDER BY created_at DESC LIMIT 1"),
    "report_queue": _sql(
        "scored reports",
        """SELECT transaction_id, ensemble_score, fired_rules, CAST(amount AS DOUBLE) AS amount, merchant_name, 0 AS retry_count
  FROM scored WHERE classification = 'fraud' AND transaction_id NOT IN (SELECT transaction_id FROM reports)""",
    ),
    "report_requests": """SELECT event_id, CASE WHEN event_id % 10 = 4 THEN 'unknown' ELSE CAST(event_id AS VARCHAR) END
    AS transaction_id, CASE WHEN event_id % 10 = 4 THEN 0 ELSE CAST(event_id % 4 AS INTEGER) END AS retry_count,
  CASE WHEN event_id % 10 = 4 THEN event_id % 100 + 0.5::DOUBLE END AS rule_score FROM events WHERE event_id % 10 <> 3""",
    "report_request_rejects": """SELECT event_id, '{"transaction_id": "' || event_id || '", "retry' AS value FROM events
  WHERE event_id % 10 = 3""",
    "prompts": _sql("scoredd", f"SELECT transaction_id, {_PROMPT} AS prompt FROM scoredd"),
    "report_outcome": _sql(
        "reports", "SELECT transaction_id, status, model_name, retry_count FROM reports WHERE report_text IS NOT NULL"
    ),
    "retry_plan": """SELECT transaction_id, retry_count, ts AS failed_at,
  CASE WHEN retry_count >= 3 THEN 'failed' ELSE 'retry' END AS outcome,
  CASE WHEN retry_count < 3 THEN retry_count + 1 END AS next_retry_count, d AS delay_seconds,
  ts + d * INTERVAL 1 SECOND AS next_attempt_at
  FROM (SELECT event_id AS transaction_id, ts, CAST(event_id % 5 AS INTEGER) AS retry_count,
    CASE event_id % 5 WHEN 0 THEN 3 WHEN 1 THEN 9 WHEN 2 THEN 27 END AS d FROM events)""",
    "abandoned_reports": """SELECT event_id AS transaction_id, 'Error después de 3 intentos: timeout ' || (event_id % 3) AS report_text,
  'failed' AS status, CAST(event_id % 5 AS INTEGER) AS retry_count, 'timeout ' || (event_id % 3) AS error, ts AS created_at
  FROM events WHERE event_id % 5 >= 3""",
    "report_status": _sql(
        "scored reports",
        """SELECT s.transaction_id, CASE WHEN r.status IS NULL THEN 404 WHEN r.status = 'pending' THEN 202 ELSE 200 END AS status_code,
  CASE WHEN r.status = 'failed' THEN 'Report generation failed. The LLM service may be unavailable.' END
    AS error_detail FROM scored s LEFT JOIN reports r USING (transaction_id)""",
    ),
    "ml_score_map": _sql(
        "tx",
        """SELECT transaction_id, round(CASE WHEN transaction_id % 7 = 0 THEN 0 ELSE greatest(0::DOUBLE, least(100::DOUBLE,
  100 * (1 - (CAST(amount AS DOUBLE) / 10000 - 1 + 0.5::DOUBLE)))) END, 6) AS ml_score FROM tx""",
    ),
    "contamination": _sql("tx", "SELECT CAST(sum(is_fraud) AS DOUBLE) / count(*) AS contamination FROM tx"),
    "csv_round_trip": _sql(
        "tx",
        """SELECT CAST(transaction_id AS VARCHAR) AS transaction_id, CAST(user_id AS VARCHAR) AS user_id,
  CAST(amount AS DOUBLE) AS amount, merchant_name, merchant_category, ts, is_fraud, CAST(hour(ts) AS INTEGER) AS hour_of_day FROM tx""",
    ),
    "appended_tables": _sql(
        "scored",
        "SELECT strftime(ts, '%Y-%m-%d') AS day, classification, count(*) AS n_scores FROM scored GROUP BY 1, 2",
    ),
    "stream_velocity": _sql("ctx", "SELECT transaction_id, n_1h, n_12h FROM ctx"),
    "stream_kpis": f"""SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY
    AS window_end, count(*) AS n_transactions, count(*) FILTER (WHERE event_type = 'error') AS n_fraud,
  {_exact('avg(value)', 4)} AS avg_score FROM events GROUP BY 1, 2""",
    "stream_unique_requests": "SELECT event_id AS transaction_id FROM events",
}

ORACLE["audit_export_json"] = ORACLE["audit_export"]

# Streams and kept tables that say what a batch query says.
for _stream, _batch in (
    ("stream_velocity_by_batch", "stream_velocity"),
    ("stream_scored_transactions", "scored_transactions"),
    ("stored_twice", "appended_tables"),
    ("stream_report_queue", "report_queue"),
    ("stream_requests", "report_requests"),
    ("stream_request_rejects", "report_request_rejects"),
    ("stream_alert_fold", "alert_fold"),
    ("stream_alert_illegal", "alert_illegal"),
    ("user_history_kept", "user_history"),
    ("known_cards_kept", "known_cards"),
    ("dashboard_kpis_kept", "dashboard_kpis"),
    ("score_histogram_kept", "score_histogram"),
    ("point_lookup_by_bucket", "point_lookup"),
):
    ORACLE[_stream] = ORACLE[_batch]
ORACLE["dashboard_lists_kept"] = f"""SELECT day AS name, n_transactions AS n FROM ({ORACLE["tx_per_day"]})
  UNION ALL SELECT rule, n_alerts FROM ({ORACLE["alerts_per_rule"]})"""
ORACLE["tracked_runs"] = f"""WITH c AS (SELECT count(*) FILTER (p AND f) AS tp, count(*) FILTER (p AND NOT f) AS fp, count(*) FILTER (NOT p AND f) AS fn
    FROM (SELECT round(value * 250, 2) > 10000 AS p, event_type = 'error' AS f FROM events)),
  m AS (SELECT tp / (tp + fp) AS pr, tp / (tp + fn) AS re FROM c)
  SELECT 'v' || i AS model_version, 'ready' AS status, {_exact('(SELECT 2 * pr * re / (pr + re) FROM m)', 4)} AS f1,
  TIMESTAMP '2024-01-29 00:00:00' + i * INTERVAL 1 DAY AS created_at FROM range(1, 3) r(i)"""
ORACLE["stream_retries"] = """SELECT event_id AS transaction_id, CASE WHEN event_id % 5 >= 3 THEN 'failed' ELSE 'retry' END AS outcome,
  CAST(event_id % 5 + CASE WHEN event_id % 5 < 3 THEN 1 ELSE 0 END AS INTEGER) AS retry_count,
  ts + CASE event_id % 5 WHEN 0 THEN 3 WHEN 1 THEN 9 WHEN 2 THEN 27 ELSE 0 END * INTERVAL 1 SECOND AS at,
  'timeout ' || (event_id % 3) AS error FROM events"""

# A stream without counts: the velocity rule stays silent, all else is as in the batch query.
PARTS["silent"] = "silent AS (SELECT * REPLACE (false AS high_velocity) FROM flags)"
PARTS["sscored"] = PARTS["scored"].replace("scored AS (", "sscored AS (", 1).replace("FROM flags)", "FROM silent)")
PARTS["saudit"] = PARTS["audit_s"].replace("audit_s AS (", "saudit AS (", 1).replace("FROM scored)", "FROM sscored)")
NEEDS.update({"silent": ["flags"], "sscored": ["silent"], "saudit": ["sscored"]})
ORACLE["stream_scores"] = _sql(
    "saudit",
    """SELECT s.transaction_id, ensemble_score, classification, fired_rules,
  CASE WHEN classification = 'fraud' THEN 'alert-' || s.transaction_id END AS alert_id, sha256_checksum
  FROM sscored s JOIN saudit a ON a.transaction_id = CAST(s.transaction_id AS VARCHAR)""",
)

ORACLE["named_features"] = _sql(
    "features",
    " UNION ALL ".join(
        f"SELECT {i}::INTEGER AS place, '{name[2:]}' AS feature, count(*) FILTER (WHERE {name} <> 0) AS n, round(max({name}), 4) AS top FROM features"
        for i, name in enumerate(FEATURES)
    ),
)
ORACLE["undefined_metrics"] = _sql(
    "pairs",
    " UNION ALL ".join(
        f"SELECT *, '{part}' AS part FROM ({_metrics(f'(SELECT {_COUNTS} FROM {rows})')})"
        for part, rows in (
            ("none", "(SELECT * FROM pairs WHERE false)"),
            ("never called", "(SELECT false AS p, a FROM pairs)"),
            ("one class", "(SELECT * FROM pairs WHERE NOT a)"),
        )
    ),
)
ORACLE["forest_trees"] = """SELECT CAST(tree AS INTEGER) AS tree, (SELECT least(256, count(*)) FROM events) AS n_drawn, 1::BIGINT AS extra_leaves,
  0::BIGINT AS n_deep, 0::BIGINT AS n_broken FROM range(100) r(tree)"""
ORACLE["forest_reloaded"] = "SELECT count(*) AS n_rows, 0::BIGINT AS n_changed, 0::BIGINT AS n_outside FROM events"
ORACLE["decision_evaluation"] = _sql(
    "tx",
    f"""SELECT {_exact("tp / (tp + fp)", 4)} AS precision, {_exact("tp / (tp + fn)", 4)} AS recall, {_exact("pr_auc", 4)} AS pr_auc,
  {_exact("roc_auc", 4)} AS roc_auc, tp + fp + tn + fn AS n_samples, tp + fp AS n_anomalies
  FROM (SELECT {_COUNTS} FROM (SELECT amount > 8000 AS p, is_fraud = 1 AS a FROM tx)), ({_AREA})""",
    _areas("SELECT CAST(amount AS DOUBLE) - 8000 AS score, is_fraud AS actual FROM tx"),
)

# The same draws: the words of MD5 digests of seed, row or user, and number, as shares of 2^32.
_DRAWS = (
    "user fraud pattern tier radius angle amount merchant burst odd currency hours burst_hours burst_minutes hour minute second"
).split()


def _draw(of: str, place: int) -> str:
    return f"(CAST('0x' || substr(md5('42:{of}:' || id || ':{place // 4}'), {1 + place % 4 * 8}, 8) AS BIGINT) / 4294967296::DOUBLE)"


ORACLE["synthetic_transactions"] = f"""WITH d AS (
  SELECT id, {", ".join(f"{_draw('row', i)} AS u_{name}" for i, name in enumerate(_DRAWS))} FROM (SELECT event_id AS id FROM events)),
u AS (SELECT id AS row_id, CAST(floor(u_user * 250) AS INTEGER) AS id, * EXCLUDE (id) FROM d),
r AS (SELECT *, 20 + 180 * {_draw("user", 0)} AS mean, 10 + 40 * {_draw("user", 1)} AS std, u_fraud < 0.05 AS fraud,
    CASE WHEN u_pattern < 0.4 THEN 'outlier' WHEN u_pattern < 0.4 + 0.3 THEN 'merchant' WHEN u_pattern < 0.4 + 0.3 + 0.2 THEN 'night' ELSE 'round' END AS kind,
    CASE WHEN u_tier < 0.7 THEN 'low' WHEN u_tier < 0.7 + 0.25 THEN 'medium' ELSE 'high' END AS tier FROM u),
s AS (SELECT *, CASE WHEN NOT fraud THEN tier WHEN kind = 'merchant' THEN 'high' ELSE 'medium' END AS shop,
    round(CASE WHEN NOT fraud THEN greatest(1, mean + std * sqrt(-2 * ln(1 - u_radius)) * cos(u_angle * 2 * pi()))
      WHEN kind = 'outlier' THEN mean + std * (5 + 15 * u_amount) WHEN kind = 'merchant' THEN 100 + 4900 * u_amount
      WHEN kind = 'night' THEN 50 + 450 * u_amount
      ELSE [500, 1000, 2000, 5000, 10000, 50000][CAST(floor(u_amount * 6) AS INTEGER) + 1] END, 2) AS amount,
    CASE WHEN fraud THEN 'high_risk' ELSE tier || '_risk' END AS category,
    TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * CAST(CASE WHEN fraud AND u_burst < 0.3
      THEN floor(u_burst_hours * 3) * 60 + floor(u_burst_minutes * 11) ELSE floor(u_hours * 721) * 60 END AS INTEGER) AS moment,
    CASE WHEN u_odd < 0.005 THEN floor(u_hour * 6) ELSE floor(u_hour * 16) + 8 END AS clock FROM r)
SELECT printf('tx-%06d', row_id) AS transaction_id, printf('user-%04d', id) AS user_id, amount,
  ['USD', 'EUR', 'GBP', 'CAD'][CAST(floor(u_currency * 4) AS INTEGER) + 1] AS currency,
  printf('%s merchant %02d', shop, CAST(floor(u_merchant * CASE shop WHEN 'low' THEN 20 ELSE 10 END) AS INTEGER) + 1) AS merchant_name,
  category AS merchant_category, strftime(moment, '%Y-%m-%d') || printf('T%02d:%02d:%02d+00:00', CAST(clock AS INTEGER),
    CAST(floor(u_minute * 60) AS INTEGER), CAST(floor(u_second * 60) AS INTEGER)) AS "timestamp", CAST(fraud AS INTEGER) AS is_fraud,
  CAST(hour(moment) AS INTEGER) AS hour_of_day, CAST(isodow(moment) >= 6 AS INTEGER) AS is_weekend,
  CAST(category = 'high_risk' AS INTEGER) AS is_crypto, CAST(amount % 100 = 0 AS INTEGER) AS amount_round_number,
  round(mean, 2) AS user_avg_amount, round(std, 2) AS user_std_amount FROM s"""
