"""SQL that gives the rows of ``catalog``'s queries, written for DuckDB.

The statements restate each operator relationally, on their own: theta joins
in place of pruned ones, and a recursive walk in place of parallel rounds.
"""

from __future__ import annotations

from tallyloom import domain
from tallyloom.plans.reports import LEGEND

_L = f"lines AS MATERIALIZED ({domain.LINES_SQL})"
_D = f"d AS MATERIALIZED ({domain.DOCUMENTS_SQL})"
_T = f"t AS MATERIALIZED ({domain.TRANSACTIONS_SQL})"
_OUT = "o AS (SELECT * FROM t WHERE direction = 'outgoing')"
BASE = f"WITH RECURSIVE {_L}, {_D}, {_T}, {_OUT}"
U = "::DECIMAL(9,6)"


def norm(x: str) -> str:
    """Normal form of ASCII names without legal endings."""
    return f"trim(regexp_replace(replace(replace(replace(upper({x}), ' & ', ' AND '), '.', ''), '''', ''), '[^A-Z0-9&]+', ' ', 'g'))"


def lcs(pairs: str) -> str:
    """CTEs that add micros, the similarity, to different pairs (a, b) of names."""
    return f"""
    p0 AS (SELECT DISTINCT a, b, array_to_string(list_sort(string_split(a, ' ')), ' ') AS x,
                  array_to_string(list_sort(string_split(b, ' ')), ' ') AS y FROM ({pairs}) WHERE a <> '' AND b <> ''),
    rows_(x, y, i, r) AS (
      SELECT DISTINCT x, y, 0, list_transform(range(0, len(y) + 1), lambda k: 0) FROM p0
      UNION ALL
      SELECT x, y, i + 1, list_reduce(range(1, len(y) + 1), lambda acc, j:
        list_append(acc, CASE WHEN substr(x, i + 1, 1) = substr(y, j, 1) THEN r[j] + 1 ELSE greatest(r[j + 1], acc[len(acc)]) END), [0])
      FROM rows_ WHERE i < len(x)
    ),
    sim AS MATERIALIZED (
      SELECT a, b, (4 * 1000000 * r[len(r)] + len(p0.x) + len(p0.y)) // (2 * (len(p0.x) + len(p0.y))) AS micros
      FROM p0 JOIN rows_ q ON q.x = p0.x AND q.y = p0.y AND q.i = len(q.x)
    )"""


#: The signal of pairs in sim: brand words lift, short names cap.
SIGNAL = """
    sig AS MATERIALIZED (
      SELECT a, b, CASE WHEN least(len(a), len(b)) < 4 THEN least(m, 350000) ELSE m END AS signal FROM (
        SELECT a, b, CASE WHEN len(la) > 0 AND len(lb) > 0 AND (
            len(list_filter(lb, lambda w: starts_with(w, la[1]) OR starts_with(la[1], w))) > 0
            OR len(list_filter(la, lambda w: starts_with(w, lb[1]) OR starts_with(lb[1], w))) > 0)
          THEN greatest(micros, 950000) ELSE micros END AS m
        FROM (SELECT *, list_filter(string_split(a, ' '), lambda w: len(w) >= 4) AS la,
                     list_filter(string_split(b, ' '), lambda w: len(w) >= 4) AS lb FROM sim))
    )"""

NAMES = f"""
    n AS (SELECT DISTINCT {norm("p_name")} AS name, p_brand, p_size FROM part),
    np AS (SELECT DISTINCT a.name AS a, b.name AS b FROM n a JOIN n b USING (p_brand, p_size) WHERE a.name < b.name)"""


def compact(x: str) -> str:
    return f"regexp_replace(upper(coalesce({x}, '')), '[^A-Z0-9]', '', 'g')"


def useful(x: str) -> str:
    return f"(len({x}) >= 5 AND (CASE WHEN regexp_full_match({x}, '[0-9]+') THEN len({x}) >= 8 ELSE regexp_matches({x}, '[A-Z]') END))"


def tokens(x: str) -> str:
    split = f"regexp_extract_all(upper({x}), '[A-Z0-9]+')"
    return f"list_filter({split}, lambda w: {useful('w')})"


def reference(description: str, invoice: str, text: str) -> str:
    both = compact(f"concat_ws(' ', {invoice}, {text})")
    return f"""CASE WHEN {compact(invoice)} <> '' AND {useful(compact(invoice))} AND contains({compact(description)}, {compact(invoice)}) THEN 1000000
      WHEN {both} = '' THEN NULL
      WHEN len(list_filter({tokens(description)}, lambda w: contains({both}, w))) > 0 THEN 1000000 ELSE 0 END"""


def date_score(gap: str) -> str:
    return f"CASE WHEN {gap} IS NULL THEN NULL WHEN {gap} <= 0 THEN 1000000 WHEN {gap} <= 1 THEN 900000 WHEN {gap} <= 3 THEN 450000 WHEN {gap} <= 5 THEN 200000 ELSE 0 END"


TOTAL = """(2 * (400000::BIGINT * coalesce(amount_score, 0) + 150000::BIGINT * coalesce(currency_score, 0) + 250000::BIGINT * coalesce(merchant_score, 0)
  + 100000::BIGINT * coalesce(date_score, 0) + 100000::BIGINT * coalesce(reference_score, 0)) + 1000000) // 2000000"""
STATUS = """CASE WHEN score >= 850000 AND amount_score = 1000000 AND currency_score = 1000000
    AND (coalesce(merchant_score, 0) >= 900000 OR coalesce(reference_score, 0) = 1000000) THEN 'CONFIRMED'
  WHEN score >= 600000 AND (coalesce(merchant_score, 0) >= 700000 OR coalesce(reference_score, 0) = 1000000) THEN 'PROBABLE' ELSE 'MISSING' END"""
SCORES = ("score", "amount_score", "currency_score", "merchant_score", "date_score", "reference_score")
UNITS = ", ".join(f"({s} / 1000000){U} AS {s}" for s in SCORES)

_PREPARED = f"""
    tn AS MATERIALIZED (SELECT *, {norm("merchant_raw")} AS m1, {norm("description")} AS m3 FROM o),
    dn AS MATERIALIZED (SELECT *, {norm("merchant_raw")} AS m1 FROM d),
    j AS MATERIALIZED (
      SELECT tn.scope_id, tn.id AS transaction_id, tn.posted_date, tn.amount AS t_amount, tn.currency AS t_currency, tn.description, tn.m1, tn.m3,
             dn.id AS document_id, dn.issued_date, dn.amount, dn.currency, dn.invoice_number, dn.extracted_text, dn.m1 AS dm
      FROM tn JOIN dn ON tn.scope_id = dn.scope_id AND (dn.currency IS NULL OR dn.currency = tn.currency)
    )"""

#: Signals of all pairs of j that need them: sig holds each pair of names.
_PAIRS = f"""
    pairs AS MATERIALIZED (
      SELECT j.*, abs(posted_date - issued_date) AS gap,
        CASE WHEN currency IS NULL THEN NULL WHEN amount = t_amount THEN 1000000 ELSE 0 END AS amount_score,
        CASE WHEN currency IS NULL THEN NULL ELSE 1000000 END AS currency_score,
        greatest(s1.signal, s3.signal) AS merchant_score, {date_score("abs(posted_date - issued_date)")} AS date_score,
        {reference("description", "invoice_number", "extracted_text")} AS reference_score
      FROM j LEFT JOIN sig s1 ON s1.a = j.m1 AND s1.b = j.dm LEFT JOIN sig s3 ON s3.a = j.m3 AND s3.b = j.dm
    ),
    single AS MATERIALIZED (SELECT *, {STATUS} AS status FROM (SELECT *, {TOTAL} AS score FROM pairs))"""

_SIG_ALL = f"{lcs('SELECT m1 AS a, dm AS b FROM j UNION SELECT m3, dm FROM j')}, {SIGNAL}"

_POOL = """
    pool AS MATERIALIZED (
      SELECT * FROM (
        SELECT j.*, s.signal AS pool_merchant, row_number() OVER (PARTITION BY scope_id, transaction_id
          ORDER BY coalesce(s.signal, -1000000) DESC, coalesce(abs(issued_date - posted_date), 1000000000), amount DESC, document_id) AS place
        FROM j LEFT JOIN sig s ON s.a = j.m1 AND s.b = j.dm WHERE j.currency IS NOT NULL AND amount < t_amount
      ) WHERE place <= 12
    )"""
_SETS = """
    sets AS MATERIALIZED (
      SELECT a.scope_id, a.transaction_id, [a.place, b.place] AS places FROM pool a JOIN pool b
        ON a.transaction_id = b.transaction_id AND b.place > a.place WHERE a.amount + b.amount = a.t_amount
      UNION ALL
      SELECT a.scope_id, a.transaction_id, [a.place, b.place, c.place] FROM pool a JOIN pool b
        ON a.transaction_id = b.transaction_id AND b.place > a.place JOIN pool c ON a.transaction_id = c.transaction_id AND c.place > b.place
      WHERE a.amount + b.amount + c.amount = a.t_amount
    )"""
_COMBOS = f"""
    members AS (
      SELECT s.transaction_id, s.places, p.place, x.document_id, x.merchant_score, x.gap, x.reference_score, x.scope_id, x.posted_date
      FROM (SELECT *, unnest(places) AS place FROM sets) s JOIN pool p ON p.transaction_id = s.transaction_id AND p.place = s.place
        JOIN pairs x ON x.transaction_id = p.transaction_id AND x.document_id = p.document_id
    ),
    combo AS MATERIALIZED (
      SELECT *, {STATUS} AS status FROM (SELECT *, {TOTAL} AS score FROM (
        SELECT scope_id, transaction_id, posted_date, list(document_id ORDER BY place) AS document_ids, 1000000 AS amount_score, 1000000 AS currency_score,
          CASE WHEN count(merchant_score) = count(*) THEN min(merchant_score) END AS merchant_score,
          {date_score("max(gap)")} AS date_score, max(gap) AS gap, max(reference_score) AS reference_score
        FROM members GROUP BY scope_id, transaction_id, posted_date, places))
    )"""
_OFFERS = """
    offers AS MATERIALIZED (
      SELECT *, row_number() OVER (PARTITION BY scope_id
        ORDER BY CASE status WHEN 'CONFIRMED' THEN 0 ELSE 1 END, score DESC, len(document_ids), transaction_id, document_ids) AS place
      FROM (
        SELECT scope_id, transaction_id, posted_date, [document_id] AS document_ids, issued_date, gap, status, score, amount_score, currency_score,
               merchant_score, date_score, reference_score, false AS group_amount_exact FROM single
        UNION ALL
        SELECT scope_id, transaction_id, posted_date, document_ids, NULL, gap, status, score, amount_score, currency_score,
               merchant_score, date_score, reference_score, true FROM combo
      ) WHERE status <> 'MISSING'
    )"""
#: A walk in rank order that carries what is used; one chain for each scope.
_WALK = """
    walk(scope_id, place, used, taken) AS (
      SELECT DISTINCT scope_id, 0::BIGINT, []::VARCHAR[], false FROM offers
      UNION ALL
      SELECT w.scope_id, w.place + 1, CASE WHEN free THEN list_concat(used, res) ELSE used END, free FROM (
        SELECT w.*, list_concat([q.transaction_id], q.document_ids) AS res,
               NOT list_has_any(w.used, list_concat([q.transaction_id], q.document_ids)) AS free
        FROM walk w JOIN offers q ON q.scope_id = w.scope_id AND q.place = w.place + 1) w
    ),
    chosen AS MATERIALIZED (SELECT q.* FROM offers q JOIN walk w ON w.scope_id = q.scope_id AND w.place = q.place AND w.taken)"""
SCORED = f"{BASE}, {_PREPARED}, {_SIG_ALL}, {_PAIRS}"
POOLED = f"{SCORED}, {_POOL}"
MATCHED = f"{POOLED}, {_SETS}, {_COMBOS}, {_OFFERS}, {_WALK}"
_M = f"""{MATCHED},
    m AS MATERIALIZED (
      SELECT o.scope_id, o.id AS transaction_id, coalesce(c.status, 'MISSING') AS status, coalesce(c.score, 0) AS score, c.amount_score,
             c.currency_score, c.merchant_score, c.date_score, c.reference_score, coalesce(c.group_amount_exact, false) AS group_amount_exact,
             coalesce(c.document_ids, []::VARCHAR[]) AS document_ids, c.issued_date, c.gap, o.posted_date, o.amount, o.currency
      FROM o LEFT JOIN chosen c ON c.transaction_id = o.id
    ),
    links AS (SELECT scope_id, transaction_id, unnest(document_ids) AS document_id, generate_subscripts(document_ids, 1) AS pos FROM m)"""
_SHEET = f"""{_M},
    sheet AS (
      SELECT t.scope_id, t.id AS transaction_id, t.direction, t.posted_date, t.amount, t.currency, t.merchant_raw, t.description, m.status,
        CASE WHEN len(m.document_ids) > 0 THEN array_to_string(m.document_ids, '; ') END AS document_ids,
        (SELECT string_agg(d.filename, '; ' ORDER BY l.pos) FROM links l JOIN d ON d.id = l.document_id WHERE l.transaction_id = t.id) AS filenames,
        CASE WHEN m.status <> 'MISSING' THEN CASE WHEN m.group_amount_exact THEN 'Yes' ELSE 'No' END END AS combination
      FROM t LEFT JOIN m ON m.transaction_id = t.id
    )"""
_SHEET_COLUMNS = "scope_id, transaction_id, direction, posted_date, amount, currency, merchant_raw, status, document_ids, filenames, combination"
_OWN = "own AS (SELECT t.*, d.id AS d_id, d.amount AS d_amount, d.currency AS d_currency, d.issued_date, d.invoice_number, d.extracted_text FROM t JOIN d ON split_part(d.id, '-', 2) = split_part(t.id, '-', 2))"
_CONTRACTS = """WITH k AS (
  SELECT c_custkey AS scope_id, c_custkey AS k, 100 + c_custkey % 50 AS fee, (c_custkey % 14)::INTEGER AS months,
         make_date(2020 + c_custkey % 3, 1 + c_custkey % 12, 1) AS first FROM customer
)"""
_REQUIRED = f"""{_CONTRACTS}, req AS (
  SELECT scope_id, i::INTEGER AS ord, strftime(first + to_months(i::INTEGER), '%Y-%m') AS period, fee::DECIMAL(28,8) AS amount, 'EUR' AS currency, true AS monthly
  FROM (SELECT *, unnest(range(0, months + 1)) AS i FROM k WHERE k % 5 <> 2 AND k % 7 <> 3 AND k % 11 <> 4)
  UNION ALL
  SELECT scope_id, i::INTEGER, strftime(first + to_months((2 * i)::INTEGER), '%Y-%m'), fee::DECIMAL(28,8), 'EUR', false
  FROM (SELECT *, unnest(range(0, 2)) AS i FROM k WHERE k % 5 = 2)
)"""
_ROWS = """st AS (
  SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY id) - 1 AS n FROM t WHERE direction <> 'unknown'
)"""


def _sets_of(n: int) -> str:
    """Sets of ``n`` members of a pool, by joining it with itself."""
    names = "abcde"[:n]
    joins = " ".join(f"JOIN pool {y} ON a.transaction_id = {y}.transaction_id AND {y}.place > {x}.place" for x, y in zip(names, names[1:]))
    return f"SELECT a.transaction_id, concat_ws('-', {', '.join(f'{x}.place' for x in names)}) AS places FROM pool a {joins} WHERE {' + '.join(f'{x}.amount' for x in names)} = a.t_amount"


def oracle_sql() -> dict[str, str]:
    q = {}
    q["outgoing_filter"] = f"{BASE} SELECT scope_id, id, posted_date, amount, currency FROM o"
    q["parse_amount_formats"] = """
      SELECT o_orderkey, o_totalprice::DECIMAL(18,2)::DECIMAL(28,8) AS amount,
        CASE (o_orderkey // 5) % 5 WHEN 0 THEN 'EUR' WHEN 1 THEN 'EUR' WHEN 2 THEN 'USD' WHEN 3 THEN 'GBP' END AS currency, NULL::VARCHAR AS error
      FROM orders"""
    q["parse_amount_rejects"] = """
      SELECT o_orderkey, NULL::DECIMAL(28,8) AS amount, CASE o_orderkey % 4 WHEN 0 THEN 'ambiguous currency' WHEN 1 THEN 'conflicting currency'
        WHEN 2 THEN 'ambiguous amount' ELSE 'invalid amount' END AS error FROM orders"""
    q["parse_date_formats"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN o_orderdate::DATE END AS parsed FROM orders"
    q["normalize_merchant"] = """
      SELECT p_partkey, upper(p_name) || CASE p_partkey % 5 WHEN 3 THEN 'S AND CO' WHEN 4 THEN ' X' ELSE '' END AS name FROM part"""
    q["merchant_similarity"] = f"WITH RECURSIVE {NAMES}, {lcs('SELECT a, b FROM np')} SELECT a, b, (micros / 1000000){U} AS similarity FROM sim"
    q["merchant_signal"] = f"WITH RECURSIVE {NAMES}, {lcs('SELECT a, b FROM np')}, {SIGNAL} SELECT a, b, (signal / 1000000){U} AS signal FROM sig"
    q["document_id"] = "SELECT p_partkey, sha256(p_name) AS document_id FROM part"
    parts = ["source_file", "strftime(posted_date, '%Y-%m-%d')", "lower(direction)", "regexp_replace(amount::VARCHAR, '\\.?0+$', '')", "currency", "trim(description)", "'1'", "''"]
    payload = " || chr(10) || ".join(f"len({p}) || ':' || {p}" for p in parts)
    q["transaction_id"] = f"{BASE} SELECT id, sha256({payload}) AS transaction_id FROM t"
    q["reference_tokens"] = f"""{BASE} SELECT id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS tokens
      FROM (SELECT id, {tokens("description")} AS w FROM t)"""
    q["reference_signal"] = f"{BASE}, {_OWN} SELECT d_id AS id, (({reference('description', 'invoice_number', 'extracted_text')}) / 1000000){U} AS reference FROM own"
    q["date_bands"] = f"""{BASE}, {_OWN} SELECT d_id AS id, abs(posted_date - issued_date)::INTEGER AS gap,
      (({date_score("abs(posted_date - issued_date)")}) / 1000000){U} AS date_score FROM own"""
    q["currency_safe_equal"] = f"""{BASE}, {_OWN} SELECT d_id AS id,
      CASE WHEN d_currency IS NOT NULL THEN currency = d_currency AND abs(amount - d_amount) <= 0.01 END AS equal FROM own"""
    q["extract_fields"] = f"{BASE} SELECT id, issued_date, amount, currency, merchant_raw, invoice_number FROM d"
    q["extract_ambiguous"] = f"""{BASE} SELECT id, NULL::DATE AS issued_date, NULL::DECIMAL(28,8) AS amount, NULL::VARCHAR AS currency,
      NULL::VARCHAR AS merchant_raw, invoice_number FROM d"""
    q["invoice_period_vote"] = f"{BASE} SELECT id, CASE WHEN right(id, 1) <> '3' OR issued_date < DATE '1999-12-01' THEN strftime(issued_date, '%Y-%m') END AS period FROM d"
    unable = "The contract does not clearly specify the invoice schedule/amount. "
    q["contract_status"] = f"""{_REQUIRED} SELECT k.scope_id, count(req.ord) > 0 AS determined,
      CASE WHEN k.k % 5 = 2 THEN NULL WHEN k.k % 7 = 3 THEN '{unable}No monthly invoice schedule was stated.'
        WHEN k.k % 11 = 4 THEN '{unable}No contract period was stated.' END AS reason, count(req.ord) AS n
      FROM k LEFT JOIN req USING (scope_id) GROUP BY k.scope_id, k.k"""
    q["contract_months"] = f"{_REQUIRED} SELECT scope_id, ord, period, amount, currency FROM req WHERE monthly"
    q["contract_explicit_lines"] = f"{_REQUIRED} SELECT scope_id, ord, period, amount, currency FROM req WHERE NOT monthly"
    q["expected_vs_found"] = f"""{_REQUIRED} SELECT scope_id, ord, period, CASE WHEN period LIKE year(first) || '-%' THEN
        CASE right(period, 2) WHEN '02' THEN 'f1' WHEN '04' THEN 'f2' WHEN '06' THEN 'f3' END END AS found FROM req JOIN k USING (scope_id)"""
    q["score_single_pairs"] = f"{SCORED} SELECT transaction_id, document_id, status, {UNITS} FROM single WHERE status <> 'MISSING'"
    q["combination_pool_topk"] = f"{POOLED} SELECT transaction_id, document_id, place::INTEGER AS place, (pool_merchant / 1000000){U} AS pool_merchant FROM pool"
    q["combination_subsets"] = f"{POOLED}, {_SETS} SELECT transaction_id, array_to_string(places, '-') AS places FROM sets"
    q["score_combinations"] = f"{POOLED}, {_SETS}, {_COMBOS} SELECT transaction_id, array_to_string(document_ids, ';') AS document_ids, status, {UNITS} FROM combo WHERE status <> 'MISSING'"
    q["proposal_rank"] = f"{POOLED}, {_SETS}, {_COMBOS}, {_OFFERS} SELECT scope_id, transaction_id, array_to_string(document_ids, ';') AS document_ids, place FROM offers"
    q["greedy_assignment"] = f"""WITH RECURSIVE i AS (
        SELECT l_orderkey, min(l_partkey) AS p, max(l_suppkey) AS s FROM lineitem GROUP BY 1
      ), w AS (SELECT o_custkey AS scope_id, l_orderkey, s, p + unnest([0, 1, 2]) AS w FROM i JOIN orders ON o_orderkey = l_orderkey),
      offers AS MATERIALIZED (
        SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY score DESC, transaction_id, document_ids) AS place FROM (
          SELECT DISTINCT scope_id, (s * 7 + w * 13) % 1000 AS score, 't' || l_orderkey AS transaction_id, ['d' || (w % 8)] AS document_ids FROM w)
      ), {_WALK} SELECT scope_id, transaction_id, document_ids[1] AS document_id FROM chosen"""
    q["match_transactions"] = f"{_M} SELECT scope_id, transaction_id, status, {UNITS}, group_amount_exact, array_to_string(document_ids, ';') AS document_ids FROM m"
    q["match_reasons"] = f"""{_M}, own AS (SELECT scope_id, unnest(document_ids) AS document_id, transaction_id AS owner, place AS owner_place FROM chosen),
      hit AS (SELECT q.transaction_id, x.document_id, own.owner, row_number() OVER (PARTITION BY q.transaction_id ORDER BY q.place, x.pos) AS k
        FROM offers q, LATERAL (SELECT unnest(q.document_ids) AS document_id, generate_subscripts(q.document_ids, 1) AS pos) x
        JOIN own ON own.scope_id = q.scope_id AND own.document_id = x.document_id AND own.owner_place < q.place
        WHERE q.transaction_id NOT IN (SELECT transaction_id FROM chosen))
      SELECT m.transaction_id, CASE
        WHEN m.status = 'MISSING' AND hit.owner IS NOT NULL THEN 'Document ' || hit.document_id || ' is already used by transaction ' || hit.owner
          || '. The same document is not assigned to a second transaction.'
        WHEN m.status = 'MISSING' THEN 'No supporting document found with sufficient evidence.'
        ELSE CASE WHEN group_amount_exact THEN 'Documents in the same currency sum to the transaction amount'
            WHEN amount_score = 1000000 AND currency_score = 1000000 THEN 'Exact amount and currency'
            WHEN amount_score = 0 THEN 'Amount differs' ELSE 'Amount or currency is missing' END
          || '; ' || CASE WHEN merchant_score IS NULL THEN 'merchant was not available' WHEN merchant_score >= 900000 THEN 'strong merchant match'
            WHEN merchant_score >= 700000 THEN 'merchant similarity is moderate' ELSE 'merchant similarity is weak' END
          || '; ' || CASE WHEN gap IS NULL THEN 'document date is missing' WHEN gap = 0 THEN 'dates are the same day'
            WHEN len(document_ids) = 1 THEN 'document date is ' || gap || CASE WHEN gap = 1 THEN ' day ' ELSE ' days ' END
              || CASE WHEN m.issued_date < m.posted_date THEN 'before' ELSE 'after' END || ' the transaction'
            ELSE 'dates differ by up to ' || gap || CASE WHEN gap = 1 THEN ' day' ELSE ' days' END END
          || CASE WHEN reference_score = 1000000 THEN '; invoice or reference text matches' ELSE '' END
          || '. Classified as ' || m.status || '.' END AS reason
      FROM m LEFT JOIN hit ON hit.transaction_id = m.transaction_id AND hit.k = 1"""
    q["document_references"] = f"""{_M} SELECT d.id AS document_id, coalesce(string_agg(l.transaction_id, ';' ORDER BY l.transaction_id), '') AS transaction_ids
      FROM d LEFT JOIN links l ON l.document_id = d.id GROUP BY d.id"""
    q["unmatched_documents"] = f"{_M} SELECT scope_id, id, amount, currency FROM d WHERE id NOT IN (SELECT document_id FROM links)"
    q["population_check"] = "SELECT 0::BIGINT AS problems"
    states = ", ".join(f"count_if(status = '{s.upper()}') AS {s}" for s in ("confirmed", "probable", "missing"))
    q["status_summary"] = f"""{_M},
      a AS (SELECT scope_id, count_if(direction = 'outgoing') AS outgoing, count_if(direction = 'incoming') AS incoming,
              min(posted_date) AS first_date, max(posted_date) AS last_date FROM t GROUP BY 1),
      b AS (SELECT scope_id, {states} FROM m GROUP BY 1),
      c AS (SELECT d.scope_id, count(*) AS documents, count(l.document_id) AS used_documents FROM d LEFT JOIN links l ON l.document_id = d.id GROUP BY 1)
      SELECT scope_id, first_date, last_date, outgoing::BIGINT AS outgoing, incoming::BIGINT AS incoming, coalesce(confirmed, 0)::BIGINT AS confirmed,
        coalesce(probable, 0)::BIGINT AS probable, coalesce(missing, 0)::BIGINT AS missing, documents, used_documents, documents - used_documents AS unmatched_documents
      FROM a LEFT JOIN b USING (scope_id) LEFT JOIN c USING (scope_id)"""
    sums = ", ".join(f"coalesce(sum(amount) FILTER (status = '{s.upper()}'), 0)::DECIMAL(38,8) AS {s}" for s in ("confirmed", "probable", "missing"))
    q["currency_totals"] = f"{_M} SELECT scope_id, currency, sum(amount)::DECIMAL(38,8) AS total, {sums} FROM m GROUP BY 1, 2"
    q["coverage"] = f"""{_M}, a AS (SELECT scope_id, count(*) AS n, count_if(status = 'CONFIRMED') AS c, sum(amount)::DOUBLE AS v,
          coalesce(sum(amount) FILTER (status = 'CONFIRMED'), 0)::DOUBLE AS w FROM m GROUP BY 1)
      SELECT t.scope_id, round(any_value(a.c) / any_value(a.n), 4)::DECIMAL(9,4) AS by_count, round(any_value(a.w) / any_value(a.v), 4)::DECIMAL(9,4) AS by_amount
      FROM t LEFT JOIN a USING (scope_id) GROUP BY 1"""
    totals = {"Outgoing": "total", "Confirmed": "confirmed", "Probable": "probable", "Missing": "missing"}
    period = "CASE WHEN min(posted_date) = max(posted_date) THEN min(posted_date)::VARCHAR ELSE min(posted_date)::VARCHAR || ' to ' || max(posted_date)::VARCHAR END"
    pick = lambda at, section, metric, value, source: f"SELECT scope_id, {at} AS spot, '{section}' AS section, {metric} AS metric, ({value})::VARCHAR AS value FROM {source}"
    one = lambda at, section, metric, value, source="ss": pick(f"({at}, '', 0)", section, f"'{metric}'", value, source)
    lines = [
        one(1, "General", "Reporting period", "period", "g"), one(2, "General", "Bank statements", "files", "g"), one(3, "General", "Total transactions", "total", "g"),
        one(4, "General", "Outgoing transactions", "outgoing"), one(5, "General", "Incoming transactions", "incoming"),
        one(6, "General", "Unclassified transactions", "unclear", "g WHERE unclear > 0"),
        *[one(7 + i, "Reconciliation", f"{s.capitalize()} transactions", s) for i, s in enumerate(("confirmed", "probable", "missing"))],
        one(10, "Reconciliation", "Supporting documents", "documents"), one(11, "Reconciliation", "Matched documents", "used_documents"),
        one(12, "Reconciliation", "Unmatched documents", "unmatched_documents"),
        *[pick(f"(13, currency, {i})", "Reconciliation", f"'{label} amount (' || currency || ')'", f"format('{{:,.2f}}', {c}::DOUBLE)", "ct") for i, (label, c) in enumerate(totals.items())],
        one(14, "Coverage", "Coverage by count", "CASE WHEN outgoing > 0 THEN round(confirmed / outgoing, 4)::DECIMAL(9,4) END"),
        pick("(15, currency, 0)", "Coverage", "'Coverage by amount (' || currency || ')'", "round(confirmed::DOUBLE / total::DOUBLE, 4)::DECIMAL(9,4)", "ct"),
        *[one(16 + i, "Status", s, f"'{text}'") for i, (s, text) in enumerate(LEGEND.items())],
    ]
    general = f"""SELECT scope_id, {period} AS period, string_agg(DISTINCT source_file, '; ') AS files, count(*) AS total,
        count_if(direction = 'unknown') AS unclear FROM {{}} GROUP BY 1"""
    q["summary_sheet"] = f"""WITH ss AS ({q["status_summary"]}), ct AS ({q["currency_totals"]}), g AS ({BASE} {general.format("t")}),
      u AS ({" UNION ALL ".join(lines)})
      SELECT scope_id, (row_number() OVER (PARTITION BY scope_id ORDER BY spot) - 1)::INTEGER AS place, section, metric, value FROM u"""
    short = [("Reporting period", "period"), ("Bank statements", "files"), ("Total transactions", "coalesce(total, 0)"), ("Outgoing transactions", "coalesce(total, 0)"), ("Incoming transactions", "NULL")]
    q["summary_without_list"] = f"""{BASE}, g AS ({general.format("o")}), s AS (SELECT DISTINCT t.scope_id, g.* EXCLUDE (scope_id) FROM t LEFT JOIN g USING (scope_id))
      {" UNION ALL ".join(f"SELECT scope_id, '{m}' AS metric, ({v})::VARCHAR AS value FROM s" for m, v in short)}"""
    q["supplied_list_check"] = f"""{BASE}, k AS (SELECT *, regexp_extract(id, '([0-9]+)$', 1)::BIGINT % 9 AS k FROM t)
      SELECT scope_id, id, 'listed twice' AS gap FROM k WHERE k = 5
      UNION ALL SELECT scope_id, id, CASE k WHEN 0 THEN 'extra in result' ELSE 'differs from result' END FROM k WHERE k IN (0, 2) AND direction = 'outgoing'"""
    q["document_counts_check"] = "SELECT 0::BIGINT AS scopes"
    q["report_transactions"] = f"{_SHEET} SELECT {_SHEET_COLUMNS} FROM sheet"
    q["report_missing"] = f"{_SHEET} SELECT {_SHEET_COLUMNS} FROM sheet WHERE status = 'MISSING'"
    q["report_probable"] = f"{_SHEET} SELECT {_SHEET_COLUMNS} FROM sheet WHERE status = 'PROBABLE'"
    q["report_documents"] = f"""{_M} SELECT d.scope_id, d.id AS document_id, d.filename, d.issued_date, d.amount,
      CASE count(l.transaction_id) WHEN 0 THEN 'UNUSED' WHEN 1 THEN 'USED ONCE' ELSE 'USED MULTIPLE TIMES' END AS usage,
      coalesce(string_agg(l.transaction_id, '; ' ORDER BY l.transaction_id), '') AS transaction_ids
      FROM d LEFT JOIN links l ON l.document_id = d.id GROUP BY ALL"""
    q["report_duplicates"] = f"{_M} SELECT scope_id, document_id, 'USED MULTIPLE TIMES' AS usage FROM links GROUP BY 1, 2 HAVING count(*) > 1"
    q["report_reused_documents"] = f"""{BASE},
      f AS (SELECT scope_id, currency, min(id) AS first FROM d WHERE currency IS NOT NULL GROUP BY 1, 2),
      c AS (SELECT scope_id, id AS transaction_id, unnest(list_distinct(CASE WHEN k % 2 = 1 THEN [first, 'doc-' || k || '-1'] ELSE [first] END)) AS document_id
        FROM (SELECT *, split_part(id, '-', 2)::BIGINT AS k FROM o) JOIN f USING (scope_id, currency))
      SELECT c.scope_id, document_id, filename, 'USED MULTIPLE TIMES' AS usage, string_agg(transaction_id, '; ' ORDER BY transaction_id) AS transaction_ids
      FROM c JOIN d ON d.scope_id = c.scope_id AND d.id = document_id GROUP BY ALL HAVING count(*) > 1"""
    q["match_json_round_trip"] = f"""{_M} SELECT transaction_id, status, {UNITS}, group_amount_exact, array_to_string(document_ids, ';') AS document_ids,
      (score / 1000000){U}::VARCHAR AS score_text FROM m"""
    q["combination_sets_of_five"] = f"{POOLED} " + " UNION ALL ".join(map(_sets_of, (2, 3, 4, 5)))
    q["glyph_characters"] = """
      SELECT p_partkey, bold, x AS x0, 110 - h AS y0, (x + w + CASE WHEN odd THEN 3 ELSE 0 END)::INTEGER AS x1, CASE WHEN t = 0 THEN 110 ELSE 114 END AS y1,
        (w * h + below + odd::INTEGER)::BIGINT AS n, below::BIGINT AS below,
        CASE WHEN odd OR (t = 0 AND k IN (9, 10)) THEN NULL WHEN t = 0 THEN chr(19968 + k) ELSE chr(24064 + k) END AS ch, NOT odd AND t = 0 AND k = 9 AS twin,
        CASE WHEN NOT odd AND t = 0 AND k = 10 THEN 'characters drawn alike: x, y' END AS problem
      FROM (SELECT p_partkey, p_size::INTEGER AS k, 3 + p_size::INTEGER % 7 AS w, 5 + p_size::INTEGER // 7 AS h, p_partkey % 3 AS t, p_partkey % 11 = 0 AS odd,
              p_partkey % 2 = 0 AS bold, CASE WHEN p_partkey % 2 = 0 THEN 9 ELSE 8 END AS x, CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 3 END AS below FROM part)"""
    q["font_dimension"] = """
      SELECT c_custkey AS scope_id, font, bold, face, count(*) OVER (PARTITION BY face) AS files FROM (
        SELECT c_custkey, 'ABCDEF+ArialMT' AS font, false AS bold, 'regular:' || sha256('face ' || c_nationkey) AS face FROM customer UNION ALL
        SELECT c_custkey, 'GHIJKL+Arial-BoldMT', true, 'bold:' || sha256('face ' || c_nationkey) FROM customer)"""
    q["html_status"] = f"""{_SHEET} SELECT transaction_id, strftime(posted_date, '%Y-%m-%d') AS date, merchant_raw AS text, format('{{:,.2f}}', amount::DOUBLE) AS amount_text,
      CASE WHEN direction <> 'outgoing' OR status = 'PROBABLE' THEN 'UNKNOWN' WHEN status = 'CONFIRMED' THEN 'IDENTIFIED' ELSE 'NOT IDENTIFIED' END AS status,
      CASE WHEN direction = 'outgoing' AND status = 'CONFIRMED' THEN filenames END AS files FROM sheet"""
    money = "CASE direction WHEN 'outgoing' THEN '-' ELSE '+' END || amount::DECIMAL(18,2)::VARCHAR"
    q["statement_lines"] = f"""{BASE}, {_ROWS} SELECT scope_id, id AS reference, strftime(posted_date, '%d.%m.%Y') AS date_text, merchant_raw AS details,
      {money} AS amount_text FROM st"""
    q["statement_rows"] = f"""{BASE}, {_ROWS} SELECT scope_id, (1 + n // 20)::INTEGER AS source_page, (n + 1)::INTEGER AS source_row, posted_date, direction, amount, currency,
      id || chr(10) || merchant_raw || chr(10) || 'Card payment' AS description, merchant_raw FROM st"""
    q["statement_balance_check"] = f"""{BASE}, {_ROWS}, s AS (SELECT scope_id, coalesce(sum(amount) FILTER (direction = 'outgoing'), 0) AS paid,
        coalesce(sum(amount) FILTER (direction = 'incoming'), 0) AS received FROM st GROUP BY 1)
      SELECT scope_id, 10::DECIMAL(28,8) AS opening, (10 + received - paid)::DECIMAL(28,8) AS closing, paid::DECIMAL(28,8) AS paid,
        received::DECIMAL(28,8) AS received, NULL::VARCHAR AS problem FROM s"""
    q["statement_profile"] = f"""{BASE}, {_ROWS} SELECT scope_id, 1 + max(n) // 20 AS pages, CASE WHEN max(n) < 20 THEN '1' ELSE '1-' || (1 + max(n) // 20) END AS transaction_pages,
        count(*) AS n, count_if(direction = 'outgoing')::BIGINT AS n_outgoing, count_if(direction = 'incoming')::BIGINT AS n_incoming, 10::DECIMAL(28,8) AS opening,
        (10 + sum(CASE direction WHEN 'incoming' THEN amount ELSE -amount END))::DECIMAL(28,8) AS closing, max(currency) AS currency,
        string_agg((n + 1) || '. ' || strftime(posted_date, '%Y-%m-%d') || ' ' || merchant_raw || ' ' || {money} || ' ' || currency, chr(10) ORDER BY n) FILTER (n < 3) AS samples
      FROM st GROUP BY 1"""
    q["statement_problems"] = f"""{BASE}, {_ROWS} SELECT DISTINCT scope_id, CASE scope_id % 4 WHEN 1 THEN 'a word stands outside the columns'
      WHEN 2 THEN 'a sum is repeated' WHEN 3 THEN 'a row stands before the balances' END AS problem FROM st"""
    q["statement_pick"] = """SELECT s_suppkey AS scope_id, CASE WHEN s_suppkey % 4 IN (1, 3) THEN '2024/Statement_01.PDF' END AS statement,
      CASE WHEN s_suppkey % 4 = 2 THEN 'several bank statements found: Statement_01.PDF, parskats.pdf' END AS problem,
      CASE s_suppkey % 4 WHEN 1 THEN 1 WHEN 3 THEN 2 END::BIGINT AS others FROM supplier"""
    q["document_build"] = f"""{BASE} SELECT sha256('%PDF ' || id) AS id, id || '.pdf' AS filename, issued_date, amount, currency, invoice_number,
      'pdf_text' AS extraction_method, sha256('%PDF ' || id) AS file_hash FROM d"""
    q["input_problems"] = """
      SELECT o_orderkey, CASE WHEN k % 11 <> 3 THEN k::VARCHAR END AS id, CASE k % 5 WHEN 1 THEN 'EU' WHEN 2 THEN 'E1R' WHEN 3 THEN 'USD' ELSE 'EUR' END AS currency,
        concat_ws('; ', CASE WHEN k % 11 = 3 THEN 'id is empty' END, CASE WHEN k % 17 = 4 THEN 'posted_date is missing' END,
          CASE WHEN k % 19 = 6 THEN 'direction is not known' END, CASE WHEN k % 7 IN (2, 4) THEN 'amount is not greater than zero' END,
          CASE WHEN k % 5 IN (1, 2) THEN 'currency is not a code of three letters' END, CASE WHEN k % 13 = 5 THEN 'description is empty' END,
          CASE WHEN k % 3 = 0 AND k % 4 = 0 THEN 'source_row is not greater than zero' END) AS problems
      FROM (SELECT *, o_orderkey AS k FROM orders)"""
    q["page_ranges"] = """
      WITH a AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem),
      b AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS island FROM a),
      c AS (SELECT l_orderkey, min(l_linenumber) AS x, max(l_linenumber) AS y FROM b GROUP BY l_orderkey, island)
      SELECT l_orderkey, string_agg(CASE WHEN x = y THEN x::VARCHAR ELSE x || '-' || y END, ', ' ORDER BY x) AS page_ranges FROM c GROUP BY 1"""
    return q
