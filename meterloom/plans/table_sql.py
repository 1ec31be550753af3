"""The same results as `table_queries`, in plain SQL over the same tables."""

from __future__ import annotations

from meterloom.functions.values import NULL_TOKENS
from meterloom.sources.uploads import BAD_CSV, BAD_ENCODING, EMPTY_FILE, MISSING_AFTER, MISSING_BEFORE, NO_ROWS


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


LINEAR = "(((1000.0::double + 900.0::double * {q}) + -20000.0::double * {d}) + 5000.0::double * {t})"
LINEITEM_LINEAR = LINEAR.format(q="l_quantity", d="l_discount", t="l_tax")
TREE = """(case when l_quantity <= 25.0
  then case when l_discount <= 0.05::double then 20000.0::double else 15000.0::double end
  else case when l_tax <= 0.04::double then 60000.0::double else 55000.0::double end end)"""
SECOND_TREE = "(case when l_tax <= 0.02::double then 30000.0::double else 45000.0::double end)"
STACK = f"((10.0::double + 0.6::double * {LINEITEM_LINEAR}) + 0.4::double * {TREE})"
FOREST = f"((0.0::double + 0.5::double * {TREE}) + 0.5::double * {SECOND_TREE})"
EVENT = "round(3.0::double + 2.5::double * value, 4)"
SCORED_EVENTS = f"select event_id as row_id, {EVENT} as prediction from events"


def _lineitem(expression: str) -> str:
    return f"select l_orderkey, l_linenumber, round({expression}, 4) as prediction from lineitem"


GAPS = """gaps as (select l_orderkey, l_linenumber, l_quantity,
  nullif(l_discount, 0.1::double) as l_discount, nullif(l_tax, 0.0::double) as l_tax from lineitem)"""
EXACT = "::decimal(19,4)"  # wide enough for DuckDB to square in 128 bits

ONE_FEATURE = """
with s as (select count(*)::double as n,
    sum(l_quantity::decimal(18,4))::double as sx,
    sum(l_extendedprice::decimal(18,4))::double as sy,
    sum(l_quantity::decimal(18,4) * l_quantity::decimal(18,4))::double as sxx,
    sum(l_quantity::decimal(18,4) * l_extendedprice::decimal(18,4))::double as sxy
  from lineitem),
w as (select *, (n * sxy - sx * sy) / (n * sxx - sx * sx) as slope from s)
select 'intercept' as term, round((sy - slope * sx) / n, 6) as weight from w
union all select 'l_quantity', round(slope, 6) from w
"""

# Two features by the normal equations. Values are whole multiples of 1/10000, so
# all sums and the centred sums are exact integers.
_TWO = """
m as (select count(*)::hugeint as n, sum(a) as sa, sum(b) as sb, sum(y) as sy, sum(a * a) as saa,
    sum(b * b) as sbb, sum(a * b) as sab, sum(a * y) as say, sum(b * y) as sby from x),
c as (select n, sa, sb, sy, (n * saa - sa * sa)::double as caa, (n * sbb - sb * sb)::double as cbb,
    (n * sab - sa * sb)::double as cab, (n * say - sa * sy)::double as cay,
    (n * sby - sb * sy)::double as cby from m),
v as (select *, (cay * cbb - cby * cab) / (caa * cbb - cab * cab) as wa,
    (cby * caa - cay * cab) / (caa * cbb - cab * cab) as wb from c)
select 'intercept' as term,
  round((sy::double - wa * sa::double - wb * sb::double) / n::double / 10000, 6) as weight from v
union all select '{a}', round(wa, 6) from v
union all select '{b}', round(wb, 6) from v
"""


def _whole(value: str) -> str:
    return f"round({value} * 10000)::hugeint"


TWO_FEATURES = (
    f"with x as (select {_whole('l_quantity')} as a, {_whole('l_discount')} as b, "
    f"{_whole('l_extendedprice')} as y from lineitem),"
) + _TWO.format(a="l_quantity", b="l_discount")

# Each fold's base weights come from the sums over all other folds.
OUT_OF_FOLD = """
with f as (select l_orderkey % 5 as fold, count(*) as n,
    sum(l_extendedprice::decimal(18,4)) as sy,
    sum(l_quantity::decimal(18,4)) as sq, sum(l_discount::decimal(18,4)) as sd,
    sum(l_quantity::decimal(18,4) * l_quantity::decimal(18,4)) as sqq,
    sum(l_discount::decimal(18,4) * l_discount::decimal(18,4)) as sdd,
    sum(l_quantity::decimal(18,4) * l_extendedprice::decimal(18,4)) as sqy,
    sum(l_discount::decimal(18,4) * l_extendedprice::decimal(18,4)) as sdy
  from lineitem group by 1),
o as (select a.fold, sum(b.n)::double as n, sum(b.sy)::double as sy, sum(b.sq)::double as sq,
    sum(b.sd)::double as sd, sum(b.sqq)::double as sqq, sum(b.sdd)::double as sdd,
    sum(b.sqy)::double as sqy, sum(b.sdy)::double as sdy
  from f a join f b on a.fold <> b.fold group by a.fold),
w as (select fold, n, sy, sq, sd, (n * sqy - sq * sy) / (n * sqq - sq * sq) as wq,
    (n * sdy - sd * sy) / (n * sdd - sd * sd) as wd from o),
p as (select l_orderkey, l_linenumber, l_extendedprice,
    round((sy - wq * sq) / n + wq * l_quantity, 2) as by_quantity,
    round((sy - wd * sd) / n + wd * l_discount, 2) as by_discount
  from lineitem join w on l_orderkey % 5 = w.fold)
"""

STACK_META = (
    OUT_OF_FOLD
    + f""", x as (select {_whole('by_quantity')} as a, {_whole('by_discount')} as b,
    {_whole('l_extendedprice')} as y from p),"""
    + _TWO.format(a="by_quantity", b="by_discount")
)

STATUS_DETAIL = {
    "encoding": BAD_ENCODING,
    "malformed": BAD_CSV,
    "missing_column": f"{MISSING_BEFORE}o_custkey{MISSING_AFTER}",
    "empty": EMPTY_FILE,
    "no_rows": NO_ROWS,
}


#: The upload of an order; what has none of the first four priorities belongs to the last.
PRIORITY = """case when o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')
    then left(o_orderpriority, 1) else '5' end"""


def _status() -> str:
    outcomes = {
        # upload: (class and status by default, in strict mode, which rows are malformed)
        "1": (("ok", 200), ("ok", 200), "0"),
        "2": (("encoding", 422), ("encoding", 422), "0"),
        "3": (("missing_column", 422), ("missing_column", 422), "0"),
        "4": (("ok", 200), ("malformed", 422), "case when o_orderkey % 7 = 0 then 0 else 1 end"),
        "5": (("ok", 200), ("malformed", 422), "1"),
    }
    parts = []
    for strict in (False, True):
        for upload, (*by_mode, bad) in outcomes.items():
            error, status = by_mode[strict]
            detail = f"'{STATUS_DETAIL[error]}'" if error in STATUS_DETAIL else "null"
            parts.append(
                f"select '{upload}' as upload, {str(strict).lower()} as strict, {status} as status, "
                f"'{error}' as error_class, {detail} as detail, count(*)::bigint as rows, "
                f"sum({bad})::bigint as bad_rows from orders where {PRIORITY} = '{upload}'"
            )
        for upload, status, error in (("empty", 500, "empty"), ("header", 200, "no_rows")):
            parts.append(
                f"select '{upload}', {str(strict).lower()}, {status}, '{error}', "
                f"'{STATUS_DETAIL[error]}', 0::bigint, 0::bigint"
            )
    return "\nunion all ".join(parts)


SCORED_ORDERS = """select o_orderkey as row_id,
    round((7.0::double + 0.5::double * o_custkey) + 0.01::double * o_totalprice, 4) as prediction
    from orders"""

ORACLE = {
    "csv_scan_typed": "select * from lineitem",
    "csv_scan_quoted": f"""select doc_id,
        case when list_contains({_list(NULL_TOKENS)}, text) then null else text end as text,
        lang, source, n_chars from documents""",
    "csv_scan_inferred": """select o_orderkey, o_custkey, o_orderstatus, o_totalprice,
        strftime(o_orderdate, '%Y-%m-%d') as o_orderdate, o_orderpriority from orders""",
    "csv_scan_types_per_file": """
        with k as (select *, ['whole', 'gaps', 'price', 'flag', 'word'][o_orderkey % 5 + 1] as upload from orders)
        select upload, o_orderkey,
          case upload when 'whole' then 'BIGINT' when 'gaps' then case when o_custkey % 4 <> 0 then 'DOUBLE' end
            when 'price' then 'DOUBLE' when 'flag' then 'BOOLEAN' else 'STRING' end as kind,
          case upload when 'whole' then o_custkey when 'gaps' then case when o_custkey % 4 <> 0 then o_custkey end
            when 'price' then o_totalprice end::double as number,
          case when upload = 'flag' then o_custkey % 2 = 0 end as flag,
          case when upload = 'word' then o_orderstatus || o_custkey end as word,
          case when upload <> 'word' then o_custkey end as o_custkey from k""",
    "csv_odd_header": """select 'narrow' as upload, o_orderkey, o_custkey, o_totalprice from orders
        union all select 'wide', o_orderkey + 1, o_custkey, o_totalprice from orders""",
    "csv_sink_infinite": """select o_orderkey as row_id, case o_orderkey % 5
        when 0 then 'inf'::double when 1 then '-inf'::double when 2 then 1e300::double
        when 3 then o_totalprice end as prediction from orders""",
    "row_id_text_key": """select c_custkey, c_name,
        row_number() over (order by encode(c_name)) - 1 as row_id from customer""",
    "row_id_null_key": """
        with k as (select case when o_orderkey % 3 <> 0 then o_orderkey // 2 end as key from orders),
        n as (select key, count(*) as n from k group by key)
        select key, n, sum(n) over (order by key nulls last)::bigint - n as first_id,
            sum(n) over (order by key nulls last)::bigint - 1 as last_id from n""",
    "csv_bind_by_name": """select case when o_orderkey % 2 = 0 then 'a' else 'b' end as upload,
        o_orderkey, o_custkey, o_totalprice from orders""",
    "header_dedup": """select c_custkey as first_key, c_nationkey as second_key,
        c_acctbal as own_key_1, c_mktsegment as unnamed_3, c_custkey + 1 as third_key
        from customer""",
    "schema_infer": """
        select 1 as ord, 'event_id' as "column", 'long' as type, count(event_id) as n_values from events
        union all select 2, 'user_gap', 'double', count(*) filter (event_id % 10 <> 0) from events
        union all select 3, 'value', 'double', count(value) from events
        union all select 4, 'is_click', 'boolean', count(event_type) from events
        union all select 5, 'event_type', 'string', count(event_type) from events
        union all select 6, 'day', 'string', count(ts) from events
        union all select 7, 'nothing', 'double', 0 from events where event_id = 0
        union all select 8, 'mixed', 'string', count(user_id) from events""",
    "null_tokens": """select event_id, case when event_id % 20 = 19 then value end as value,
        case when event_id % 20 = 19 then event_type end as kind,
        case event_id % 5 when 0 then 'na' when 1 then '-' when 2 then 'NAN' when 3 then 'none' end
          as miss from events""",
    "utf8_check": """select 'upload=' || (event_id % 4) as upload,
        bool_and(event_id % 50 <> 0) as valid, count(*) as n_lines from events group by 1""",
    "ragged_rows": """select event_id,
        case when event_id % 10 in (1, 2, 3, 4) then null
             when event_id % 10 = 5 then 'a,"' || event_type || '"'
             when event_id % 10 = 6 then '5" ' || event_type else event_type end as event_type,
        case when event_id % 10 in (0, 1, 2, 3, 4) then null else value end as value,
        case when event_id % 10 in (1, 2, 3) then 'long_row' when event_id % 10 = 4 then 'open_quote'
             else 'ok' end as outcome from events""",
    "cast_quarantine": """select event_id, case when event_id % 13 >= 6 then value end as value,
        case when event_id % 13 < 6 then null
             else case event_id % 11 when 0 then 1.0 when 1 then 0.0 when 2 then 2.0
               when 3 then 1000.0 when 4 then 9223372036854775808.0 when 5 then 7.0 when 6 then 0.5
               when 7 then 5.0 else value end end::double as other,
        case when event_id % 13 < 6 then 'value' else '' end as bad_columns from events""",
    "leading_index": """select c_custkey as row_id, c_name, c_nationkey, c_acctbal from customer""",
    "leading_index_time": """
        select case when event_id % 17 <> 0 and event_id % 19 <> 0 then ts end as at, event_id,
          case when event_id % 17 <> 0 then value end as value,
          case when event_id % 17 = 0 then 'bad_index' else 'ok' end as outcome from events""",
    "leading_index_text": """select c_mktsegment as segment, c_name as name,
        round((1.0::double + 2.0::double * c_acctbal) + 0.5::double * c_custkey, 4) as prediction from customer""",
    "required_columns": """
        select flag as upload, feature, count(*) as n_rows
        from lineitem join (values ('N', 'l_discount'), ('R', 'l_quantity'), ('R', 'l_tax'))
          as missing(flag, feature)
          on case when l_returnflag in ('A', 'N') then l_returnflag else 'R' end = flag group by 1, 2""",
    "file_admission": """select upload, upload in ('click', 'signup', 'view') as admitted, count(*) as n_lines
        from (select case when event_type in ('click', 'signup', 'error', 'view') then event_type
              else 'purchase' end as upload from events) group by 1""",
    "upload_status": _status(),
    "status_model_failure": """
        select 'o_orderstatus=' || o_orderstatus as upload,
          case o_orderstatus when 'P' then 500 when 'F' then 500 else 200 end as status,
          case o_orderstatus when 'P' then 'model' when 'F' then 'model' else 'ok' end as error_class,
          case o_orderstatus when 'P' then 'no prediction for pending orders'
            when 'F' then 'All arrays must be of the same length' end as detail,
          count(*) as rows, count(*) filter (o_orderstatus not in ('P', 'F')) as n_scored,
          sum(((7.0::double + 0.5::double * o_custkey) + 0.01::double * o_totalprice)::decimal(18,4))
            filter (o_orderstatus not in ('P', 'F'))::double as total
        from orders group by o_orderstatus""",
    "row_id_keyed": """select event_id, value,
        row_number() over (order by event_id) - 1 as row_id from events""",
    "row_id_file_order": """select row_number() over (order by o_orderkey) - 1 as row_id,
        o_orderkey, o_totalprice from orders""",
    "row_id_per_upload": """
        with k as (select count(*) as n, (count(*) + 4999) // 5000 as files from orders),
        p as (select (n + files - 1) // files as per_file from k)
        select o_orderkey // per_file as upload, o_orderkey % per_file as row_id,
          o_orderkey, o_totalprice from orders, p""",
    "score_linear": _lineitem(LINEITEM_LINEAR),
    "score_tree": _lineitem(TREE),
    "score_forest": _lineitem(FOREST),
    "score_category_split": """
        select l_orderkey, l_linenumber,
          case when l_suppkey % 3 = 0 and l_suppkey < 10000
               then case when l_linenumber in (1, 3, 5) then 10.0::double else 20.0::double end
               when nullif(l_discount, 0.1::double) <= 0.05::double then 30.0::double
               when l_linenumber = 2 then 40.0::double else 50.0::double end as prediction from lineitem""",
    "score_symmetric_trees": """
        with known as (select distinct l_quantity, nullif(l_discount, 0.1::double) as l_discount,
            nullif(l_tax, 0.0::double) as l_tax from lineitem),
        leaves as (select l_quantity, l_discount, l_tax, i,
            case when l_quantity <= i then 0 else 1 end
            + case when l_discount <= (i % 11) / 100.0::double then 0 else 2 end
            + case when l_tax is null or l_tax < (i % 9) / 100.0::double then 0 else 4 end
            + case when l_quantity < i * 3 % 50 then 0 else 8 end as leaf
          from known, range(50) as r(i)),
        sums as (select l_quantity, l_discount, l_tax,
            case when l_discount is not null then 1.0::double + sum(0.5::double * ((i * 7 + leaf * 3) % 11)) end as prediction
          from leaves group by l_quantity, l_discount, l_tax)
        select l_orderkey, l_linenumber, prediction from lineitem join sums
          on lineitem.l_quantity = sums.l_quantity
          and nullif(lineitem.l_discount, 0.1::double) is not distinct from sums.l_discount
          and nullif(lineitem.l_tax, 0.0::double) is not distinct from sums.l_tax""",
    "score_model_dump": f"""with {GAPS} select l_orderkey, l_linenumber,
          0.25::double + case when l_quantity::float < 25::float
            then case when l_discount is null or l_discount::float >= 0.0500000007::float then -2.25::double
              else 1.5::double end
            else 4.0::double end
          + case when l_tax is null or l_tax::float >= 0.0399999991::float then 0.75::double else 0.5::double end as split,
          case when l_quantity <= 24 then case when l_linenumber in (1, 3, 5) then 1.0::double else 2.0::double end
            when l_tax is null or l_tax <= 0.02::double then 4.0::double else 8.0::double end as leafwise,
          0.5::double + 2.0::double * case
            when l_quantity::float > 30.5::float
            then case when l_tax is null or l_tax::float > 0.0299999993::float then 8 else 2 end
            else case when l_tax is null or l_tax::float > 0.0299999993::float then 4 else 1 end end as symmetric
        from gaps""",
    "score_stack": _lineitem(STACK),
    "score_null_features": f"""with {GAPS} select l_orderkey, l_linenumber,
        round({LINEITEM_LINEAR}, 4) as prediction,
        case when l_discount is null and l_tax is null then 'l_discount+l_tax'
             when l_discount is null then 'l_discount' when l_tax is null then 'l_tax' end
          as null_features from gaps""",
    "score_drop_null": f"""with {GAPS} select l_orderkey, l_linenumber,
        round({LINEITEM_LINEAR}, 4) as prediction from gaps
        where l_discount is not null and l_tax is not null and l_quantity is not null""",
    "score_mean_imputed": f"""with {GAPS},
        m as (select avg(l_quantity) as q, avg(l_discount) as d, avg(l_tax) as t from gaps)
        select l_orderkey, l_linenumber, round({LINEAR.format(
            q="coalesce(l_quantity, q)", d="coalesce(l_discount, d)", t="coalesce(l_tax, t)"
        )}, 4) as prediction from gaps, m""",
    "score_output": SCORED_EVENTS + " order by row_id",
    "score_uploads": SCORED_ORDERS,
    "score_uploads_python": SCORED_ORDERS,
    "score_uploads_pipeline": SCORED_ORDERS,
    "score_uploads_mean": """
        select o_orderkey as row_id, round(case when o_orderkey % 7 = 0
            then avg(o_totalprice) filter (o_orderkey % 7 <> 0) over (partition by o_orderstatus)
            else o_totalprice end, 4) as prediction from orders""",
    "score_stack_pipeline": "select count(*) as n, count(*) as n_right from lineitem",
    "score_large_ensemble": """
        with trees as (select i % 50 as q, (i % 11) / 100.0::double as d, (i % 9) / 100.0::double as t,
            i % 5 as a, i % 3 as b from range(600) as r(i)),
        known as (select distinct l_quantity, l_discount,
            case when l_linenumber <> 2 then l_tax end as l_tax from lineitem),
        sums as (select l_quantity, l_discount, l_tax, 5.0::double + sum(
            case when l_quantity <= q then case when l_discount < d then a else b end
                 else case when l_tax is null or l_tax <= t then 1 else 2 end end) as prediction
            from known, trees group by all)
        select l_orderkey, l_linenumber, prediction from lineitem join sums
          on lineitem.l_quantity = sums.l_quantity and lineitem.l_discount = sums.l_discount
          and (case when l_linenumber <> 2 then lineitem.l_tax end) is not distinct from sums.l_tax""",
    "python_model": _lineitem(LINEITEM_LINEAR),
    "model_spec_roundtrip": _lineitem(STACK),
    "model_roundtrip": """
        with w as (select regr_slope(l_extendedprice, l_quantity) as slope,
          regr_intercept(l_extendedprice, l_quantity) as base from lineitem)
        select l_orderkey, l_linenumber, round(base + slope * l_quantity, 3) as prediction
        from lineitem, w""",
    "model_compiled": "select count(*) as n, 0::bigint as n_different from lineitem",
    "fit_linear_one": ONE_FEATURE,
    "fit_linear_two": TWO_FEATURES,
    "fit_linear_many": """select 'intercept' as term, 3.0::double as weight
        union all select 'f' || i, 0.5::double * (i + 1) from range(17) as t(i)""",
    "fit_stack_oof": STACK_META,
    "score_out_of_fold": OUT_OF_FOLD
    + "select l_orderkey, l_linenumber, by_quantity, by_discount from p",
    "eval_metrics": f"""
        with e as (select l_extendedprice{EXACT} as y,
          (l_extendedprice{EXACT} - round({STACK}, 4){EXACT}){EXACT} as error from lineitem),
        s as (select count(*) as n, sum(error * error)::double as sse, sum(abs(error))::double as sae,
          sum(y)::double as sy, sum(y * y)::double as syy from e)
        select n, round(sqrt(sse / n), 6) as rmse, round(sae / n, 6) as mae,
          round(1.0::double - sse / (syy - sy * sy / n), 6) as r2 from s""",
    "csv_sink_roundtrip": f"""select row_id, prediction, row_id as place_in_files
        from ({SCORED_EVENTS})""",
    "csv_sink_joined": f"""
        select -1::bigint as line_no, 'Row Id' as row_id, null::double as prediction, true as within_bound
        union all select row_number() over (order by row_id) - 1, row_id::varchar, prediction, true
          from ({SCORED_EVENTS})""",
    "csv_sink_plain_numbers": """select o_orderkey as row_id,
        ((o_totalprice * 100000)::decimal(38,6))::varchar as printed from orders""",
    "page_slice": f"select * from ({SCORED_EVENTS}) where row_id between 60 and 69",
    "page_unnumbered": """select o_orderkey, o_totalprice from orders
        order by o_totalprice desc, o_orderkey limit 10 offset 20""",
    "pages": "select count(*) as n_rows, ceil(count(*) / 10.0)::bigint as n_pages from events",
    "page_bounds": """with c as (select ceil(count(*) / 10.0)::bigint as n_pages from events)
        select n_pages, wanted, greatest(1, least(wanted, n_pages))::bigint as shown
        from (select n_pages, unnest([0, 1, n_pages, n_pages + 1])::bigint as wanted from c)""",
    "page_summaries": f"""select row_id // 10 + 1 as page, count(*) as n_rows,
        min(row_id) as first_row_id, min(prediction) as min_prediction,
        max(prediction) as max_prediction from ({SCORED_EVENTS}) group by 1""",
    "result_display": f"select * from ({SCORED_EVENTS}) order by row_id limit 10",
    "feature_profile": "\nunion all ".join(
        f"select {i} as ord, '{name}' as feature, '{text}' as description, '{kind}' as kind, "
        f"count(*) as n_rows, count(*) - count({name}) as n_null, min({name}) as minimum, "
        f"max({name}) as maximum from lineitem"
        for i, (name, text, kind) in enumerate(
            [
                ("l_quantity", "Units ordered", "feature"),
                ("l_discount", "Discount rate", "feature"),
                ("l_tax", "Tax rate", "feature"),
                ("l_extendedprice", "Price of the line", "label"),
            ],
            start=1,
        )
    ),
    "stream_score": SCORED_EVENTS,
}
