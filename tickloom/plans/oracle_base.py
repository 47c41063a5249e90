"""Shared table expressions for the checking SQL (DuckDB text over the given tables)."""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, deps: tuple[str, ...], sql: str) -> None:
    CTES[name] = (deps, sql)


def with_ctes(names: tuple[str, ...], body: str) -> str:
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for dep in CTES[name][0]:
            visit(dep)
        done.append(name)

    for n in names:
        visit(n)
    if not done:
        return body
    parts = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in done)
    body = body.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {parts},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {parts},\n{body[5:]}"
    return f"WITH {parts}\n{body}"


def code_of(key: str) -> str:
    return (
        f"(['600','000','300','688','830'][({key})%5+1] || "
        f"lpad(CAST({key} AS VARCHAR), CAST(greatest(3, length(CAST({key} AS VARCHAR))) AS INTEGER), '0') || "
        f"['.SH','.SZ','.SZ','.SH','.BJ'][({key})%5+1])"
    )


cte("bars0", (), """
  SELECT l_suppkey AS k, CAST(date_trunc('week', l_shipdate) AS DATE) AS trade_date,
         arg_min(p, o) AS open, max(p) AS high, min(p) AS low, arg_max(p, o) AS close,
         round(sum(l_quantity*(1+l_discount)), 2) AS vol, round(sum(l_extendedprice), 2) AS amount
  FROM (SELECT *, round(10 + 0.5*ln(l_extendedprice/l_quantity/2000), 10) AS p,
               {'a': l_shipdate, 'b': l_orderkey, 'c': l_linenumber, 'd': l_partkey} AS o
        FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0)
  GROUP BY ALL""")
cte("bars", ("bars0",), f"""
  SELECT {code_of('k')} AS ts_code, trade_date, open, high, low, close,
         lag(close) OVER (PARTITION BY k ORDER BY trade_date) AS pre_close,
         vol, amount, vol/25.0 AS turnover_rate, k,
         row_number() OVER (PARTITION BY k ORDER BY trade_date) AS rn,
         count(*) OVER (PARTITION BY k) AS nbars
  FROM bars0""")
cte("vbars", ("bars",), """
  SELECT b.*, close*(s_acctbal+1000)*50 AS total_mv,
         CASE WHEN s_acctbal>0 THEN close/(s_acctbal/1000) END AS pe,
         CASE WHEN s_acctbal>0 THEN close/(s_acctbal/1000)*0.95 END AS pe_ttm,
         close/(2+k%7) AS pb, close/(0.5+(k%11)*0.4) AS ps, close/(0.5+(k%11)*0.4)*1.05 AS ps_ttm
  FROM bars b JOIN supplier ON s_suppkey = k""")
cte("stock_basic", (), f"""
  SELECT {code_of('s_suppkey')} AS ts_code, split_part({code_of('s_suppkey')}, '.', 1) AS symbol,
         CASE WHEN s_suppkey%17=3 THEN 'ST'||s_name ELSE s_name END AS name, r_name AS area, n_name AS industry,
         ['主板','主板','创业板','科创板','北交所'][s_suppkey%5+1] AS market,
         ['SSE','SZSE','SZSE','SSE','BSE'][s_suppkey%5+1] AS exchange,
         CASE WHEN s_suppkey%23=7 THEN 'D' ELSE 'L' END AS list_status,
         DATE '1990-01-01' + CAST(s_suppkey%1500 AS INTEGER) AS list_date, s_suppkey AS k
  FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey""")
cte("stock_company", (), f"""
  SELECT {code_of('s_suppkey')} AS ts_code, 'chair '||s_name AS chairman, round(s_acctbal+1000,2) AS reg_capital,
         n_name AS province, n_name||' trading' AS main_business, 'supply of '||s_name AS business_scope,
         s_name||' '||n_name AS introduction, 'www.s'||s_suppkey||'.example.com' AS website,
         CAST(trunc(abs(s_acctbal)) AS BIGINT)+10 AS employees
  FROM supplier JOIN nation ON s_nationkey=n_nationkey""")
_SEAT_KEY = "(user_id % (SELECT count(*) FROM supplier))"
cte("top_list", (), f"""
  SELECT event_id, CAST(ts AS DATE) AS trade_date, {code_of(_SEAT_KEY)} AS ts_code,
         CASE WHEN event_type IN ('purchase','view','click') THEN value ELSE value*0.25 END AS l_buy,
         CASE WHEN event_type IN ('error','signup') THEN value ELSE value*0.25 END AS l_sell,
         CASE WHEN event_type IN ('purchase','view','click') THEN value ELSE value*0.25 END
         - CASE WHEN event_type IN ('error','signup') THEN value ELSE value*0.25 END AS net_amount,
         event_type AS reason
  FROM events""")
cte("top_inst", (), f"""
  SELECT event_id, CAST(ts AS DATE) AS trade_date, {code_of(_SEAT_KEY)} AS ts_code,
         CASE event_type WHEN 'click' THEN '沪股通专用' WHEN 'view' THEN '深股通专用' WHEN 'purchase' THEN '机构专用'
              WHEN 'signup' THEN '华泰证券营业部' WHEN 'error' THEN '东方财富拉萨营业部' END AS exalter,
         CASE WHEN event_type='error' THEN value*0.5 ELSE value END AS buy,
         CASE WHEN event_type='error' THEN value ELSE value*0.5 END AS sell,
         CASE WHEN event_type='error' THEN value*0.5 ELSE value END
         - CASE WHEN event_type='error' THEN value ELSE value*0.5 END AS net_buy, event_type AS reason
  FROM events""")
cte("fin0", (), """
  SELECT l_suppkey AS k, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS q,
         (year(date_trunc('quarter', l_shipdate))-1995)*4 + quarter(l_shipdate)-1 AS qi,
         round(sum(l_extendedprice),2) AS rev0, round(sum(l_extendedprice*l_discount),2) AS disc0,
         round(sum(l_extendedprice*l_tax),2) AS tax0,
         round(sum(CASE WHEN l_returnflag='R' THEN l_extendedprice ELSE 0.0 END),2) AS ret0,
         round(sum(l_quantity),2) AS qty
  FROM lineitem GROUP BY ALL""")
cte("fin1", ("fin0",), """
  SELECT k, qi, last_day(CAST(q + INTERVAL 2 MONTH AS DATE)) AS end_date, rev, rev*0.28-ret*0.6 AS income,
         rev*0.35-ret*0.55-tax AS cash, (rev-ret*0.5-disc*4)/rev*100 AS gm,
         rev*(3+k%4) AS assets, rev*(3+k%4)*(0.15+(k%9)*0.08) AS liab,
         rev*0.3-ret*0.4-disc AS op, disc*3+tax AS ar, rev*0.6+disc AS cost, qty
  FROM (SELECT k, q, qi, qty, rev0*s AS rev, ret0*s AS ret, disc0*s AS disc, tax0*s AS tax
        FROM (SELECT *, pow(1.0+(k%7-2)*0.03, qi)*(CASE WHEN k%3=0 THEN 1.0 ELSE 1000.0 END) AS s FROM fin0))""")
cte("financial", ("fin1",), f"""
  SELECT {code_of('k')} AS ts_code, end_date, CASE WHEN k%4<>0 THEN rev END AS revenue, rev AS total_revenue,
         CASE WHEN k%5<>1 THEN income END AS net_income, CASE WHEN k%5=1 THEN income END AS n_income,
         CASE WHEN k%13<>5 THEN gm END AS gross_margin, cash AS n_cashflow_act,
         CASE WHEN k%6<>2 THEN income/(assets-liab)*100 END AS roe,
         CASE WHEN k%8<>3 THEN liab/assets*100 END AS debt_to_assets,
         CASE WHEN k%10<>4 THEN 0.8+(qty%40)/20 END AS current_ratio,
         assets AS total_assets, liab AS total_liab, assets-liab AS total_hldr_eqy,
         op AS operate_profit, op*1.05 AS ebit, income/assets AS eps,
         CASE WHEN k%12<>6 THEN (rev-pr)/abs(pr)*100 END AS or_yoy,
         CASE WHEN k%12<>7 THEN (op-po)/abs(po) END AS op_yoy,
         income*0.85 AS profit_dedt, assets*0.1+rev*0.05 AS money_cap, ar AS accounts_receiv, cost AS oper_cost, k
  FROM (SELECT *, CASE WHEN lag(qi,4) OVER w = qi-4 THEN lag(rev,4) OVER w END AS pr,
                  CASE WHEN lag(qi,4) OVER w = qi-4 THEN lag(op,4) OVER w END AS po
        FROM fin1 WINDOW w AS (PARTITION BY k ORDER BY qi))""")
