"""The same queries as SQL, written from their definitions rather than from the operators.

History and as-of features are spelled out here as joins of rows with label rows, which the
operators avoid. The dialect is DuckDB's.
"""

from __future__ import annotations

# Column names of the domain, as the operators have them.
FE = [f"fe_{i}" for i in range(1, 21)]
NUMBERS = [
    "Annual_Income",
    "Monthly_Inhand_Salary",
    "Num_of_Loan",
    "Outstanding_Debt",
    "Total_EMI_per_month",
    "Amount_invested_monthly",
    "Monthly_Balance",
]
TEXTS = ["Credit_Mix", "Payment_of_Min_Amount", "Payment_Behaviour"]
RATIOS = ["DTI", "Savings_Ratio", "Debt_to_Annual_Income"]
SUMS = ["hist_total_paid", "hist_total_due", "hist_total_overdue_amount"]
STATISTICS = [f"{c}_{s}" for s in ("mean", "std") for c in FE]


def decimal_text(cents: str) -> str:
    return (
        f"(case when ({cents}) < 0 then '-' else '' end || cast(abs({cents}) // 100 as varchar)"
        f" || '.' || lpad(cast(abs({cents}) % 100 as varchar), 2, '0'))"
    )


def rounded(columns: list[str], digits: int) -> str:
    return ", ".join(f"round(cast({c} as double), {digits}) as {c}" for c in columns)


CTES: dict[str, str] = {
    "loans": """
        select o_orderkey as loan_id, o_custkey as Customer_ID,
               cast(o_orderdate as date) as loan_start_date from orders""",
    "loan_events": """
        select l_orderkey as loan_id, cast(l_shipdate as date) as snapshot_date,
               l_quantity as loan_amt, l_extendedprice as due_amt,
               case when l_partkey % 499 = 0 then -1 else 1 end
                   * (l_extendedprice * (1 - l_discount)) as paid_amt,
               case when l_returnflag = 'R' then l_extendedprice * l_discount else 0.0 end as overdue_amt
        from lineitem""",
    "loan_daily": "select * from loan_events join loans using (loan_id)",
    "windows": """
        select *, cast(prediction_date + interval 11 month as date) as label_window_end
        from (select loan_id, Customer_ID, min(loan_start_date) as start_date,
                     cast(min(loan_start_date) + interval 1 month as date) as prediction_date
              from loans group by 1, 2)""",
    "defaults": """
        select distinct w.loan_id from windows w join loan_events e on w.loan_id = e.loan_id
        where e.snapshot_date between w.prediction_date and w.label_window_end and e.overdue_amt > 0""",
    "labels": """
        select w.Customer_ID, w.loan_id, w.prediction_date,
               case when d.loan_id is null then 0 else 1 end as label
        from windows w left join defaults d on w.loan_id = d.loan_id""",
    "texts": """
        select o_orderkey, case o_orderkey % 12
            when 0 then strftime(o_orderdate, '%-d/%-m/%Y')
            when 1 then ' ' || strftime(o_orderdate, '%d/%m/%Y') || chr(9)
            when 2 then '31/02/' || strftime(o_orderdate, '%Y')
            when 3 then strftime(o_orderdate, '%d/%m/%y')
            when 4 then strftime(o_orderdate, '%Y-%m-%d')
            when 5 then strftime(o_orderdate, '%d/%m/%Y') || ' 00:00'
            when 6 then '0' || strftime(o_orderdate, '%d/%m/%Y')
            when 7 then null
            when 8 then '31/12/9999'
            else strftime(o_orderdate, '%d/%m/%Y') end as snapshot_date_text
        from orders""",
    "parsed": r"""
        select *, case when regexp_full_match(t, '\d{1,2}/\d{1,2}/\d{4}') and not t like '%/9999'
                       then cast(try_strptime(t, '%d/%m/%Y') as date) end as snapshot_date
        from (select *, regexp_replace(snapshot_date_text, '^\s+|\s+$', '', 'g') as t from texts)""",
    "dirty_attributes": """
        select c_custkey as Customer_ID, c_name as Name,
               case when c_custkey % 17 = 0 then 'abc'
                    when c_custkey % 19 = 0 then cast(c_custkey % 120 as varchar) || '.0'
                    when c_custkey % 7 = 0 then cast(c_custkey % 120 as varchar) || '_'
                    else cast(c_custkey % 120 as varchar) end as Age,
               case when c_custkey % 13 = 0 then null when c_custkey % 11 = 0 then '#F%$D@*&8'
                    else lpad(cast(c_custkey % 1000 as varchar), 3, '0') || '-'
                      || lpad(cast(c_custkey % 100 as varchar), 2, '0') || '-'
                      || lpad(cast(c_custkey % 10000 as varchar), 4, '0') end as SSN,
               case when c_custkey % 5 = 0 then ' _______ ' when c_custkey % 9 = 0 then '_'
                    else ' ' || c_mktsegment end as Occupation
        from customer""",
    "clean_attributes": """
        select Customer_ID, Name, SSN,
               cast(trunc(try_cast(replace(Age, '_', '') as double)) as integer) as Age,
               case when trim(Occupation) in ('_______', '_') then null else Occupation end as Occupation
        from dirty_attributes""",
    "flagged_attributes": r"""
        select *, greatest(age_flag, ssn_flag) as data_quality_issue
        from (select Customer_ID, Age, SSN, case when Age < 18 or Age > 100 then 1 else 0 end as age_flag,
                     case when regexp_matches(trim(SSN), '^\d{3}-\d{2}-\d{4}$') then 0 else 1 end as ssn_flag
              from clean_attributes)""",
    "attribute_snapshots": """
        select a.*, snapshot_date, cast(year(snapshot_date) as integer) as year,
               cast(month(snapshot_date) as integer) as month
        from (select *, cast(date '1995-01-01' + cast(Customer_ID % 900 + 600 * step as integer) as date)
                     as snapshot_date
              from (select Customer_ID, unnest([0, 1, 2]) as step from clean_attributes)) s
             join clean_attributes a using (Customer_ID)""",
    "order_cents": """
        select *, o_orderkey as k, cast(round(o_totalprice * 100) as bigint) as cents from orders""",
    "dirty_financials": f"""
        select o_custkey as Customer_ID,
               case when k % 5 = 0 then '_' || {decimal_text('cents')} || '_'
                    else {decimal_text('cents')} end as Annual_Income,
               case when k % 23 = 0 then '0' when k % 29 = 0 then ''
                    else {decimal_text('cents // 12 + k % 1009 * 100')} end as Monthly_Inhand_Salary,
               cast(k % 9 as varchar) as Num_of_Loan,
               {decimal_text('case when k % 211 = 0 then -cents else cents * (k % 7) end')} as Outstanding_Debt,
               {decimal_text('cents // 100 + k % 773 * 40')} as Total_EMI_per_month,
               case when k % 31 = 0 then '__10000__' else {decimal_text('cents // 150 + k % 557 * 30')} end
                   as Amount_invested_monthly,
               {decimal_text('cents // 50 - k % 13 * 10000')} as Monthly_Balance,
               case when k % 6 = 0 then 'NM' when k % 10 = 3 then ' _ ' else o_orderpriority end as Credit_Mix,
               case when k % 8 = 0 then 'NM' else o_orderstatus end as Payment_of_Min_Amount,
               case when k % 4 = 0 then '_______' else 'plan ' || cast(k % 3 as varchar) end as Payment_Behaviour,
               case when k % 37 = 0 then null
                    when k % 41 = 0 then cast(k % 400 // 12 as varchar) || ' Year and '
                                      || cast(k % 400 % 12 as varchar) || ' Month'
                    else cast(k % 400 // 12 as varchar) || ' Years and '
                      || cast(k % 400 % 12 as varchar) || ' Months' end as Credit_History_Age,
               cast(o_orderdate as date) as snapshot_date
        from order_cents""",
    "clean_financials": f"""
        select Customer_ID, Credit_History_Age, snapshot_date,
               {', '.join(f"try_cast(replace({c}, '_', '') as float) as {c}" for c in NUMBERS)},
               {', '.join(f"case when trim({c}) in ('_______', '_', 'NM') then null else {c} end as {c}" for c in TEXTS)}
        from dirty_financials""",
    "flagged_financials": """
        select Customer_ID, snapshot_date,
               case when Annual_Income < 0 or Monthly_Inhand_Salary < 0 or Outstanding_Debt < 0
                    then 1 else 0 end as data_quality_issue
        from clean_financials""",
    "financial_features": r"""
        select *,
               12 * coalesce(try_cast(regexp_extract(Credit_History_Age, '(\d+)\s+Years', 1) as integer), 0)
                 + coalesce(try_cast(regexp_extract(Credit_History_Age, '(\d+)\s+Months', 1) as integer), 0)
                 as Credit_History_Months,
               cast(Total_EMI_per_month as double) / nullif(cast(Monthly_Inhand_Salary as double), 0) as DTI,
               cast(Amount_invested_monthly as double) / nullif(cast(Monthly_Inhand_Salary as double), 0)
                 as Savings_Ratio,
               Monthly_Inhand_Salary - Total_EMI_per_month - Amount_invested_monthly as Monthly_Surplus,
               cast(Outstanding_Debt as double) / nullif(cast(Annual_Income as double), 0)
                 as Debt_to_Annual_Income
        from clean_financials""",
    "flagged_loans": """
        select *, case when loan_amt < 0 or due_amt < 0 or paid_amt < 0 or overdue_amt < 0
                       then 1 else 0 end as data_quality_issue
        from loan_events""",
    "clicks": f"""
        select event_id, user_id as Customer_ID, cast(cast(ts as date) - 9861 as date) as snapshot_date,
               {', '.join(f"case when event_id % {i + 10} <> 0 then sqrt(value * (1 + event_id * {i} % 11)) end as fe_{i}" for i in range(1, 21))}
        from events""",
    "flagged": """
        select Customer_ID from flagged_attributes where data_quality_issue = 1
        union select Customer_ID from flagged_financials where data_quality_issue = 1
        union select l.Customer_ID from flagged_loans f join loans l using (loan_id)
              where f.data_quality_issue = 1""",
    "table_ids": """
        select 'attributes' as table_name, Customer_ID from attribute_snapshots
        union all select 'financials', Customer_ID from clean_financials
        union all select 'loan_daily', Customer_ID from loan_daily
        union all select 'clickstream', Customer_ID from clicks""",
    "silver_labels": """
        select * from labels where Customer_ID not in (select Customer_ID from flagged)
                               and loan_id in (select loan_id from loan_events)""",
}


def history_sums(labels: str, keys: str, compare: str = "<=") -> str:
    """Loan rows joined with label rows; keys are of the loan table."""
    on = "d.loan_id = s.loan_id" if keys == "d.Customer_ID" else "d.loan_id = s.loan_id and d.Customer_ID = s.Customer_ID"
    return f"""
        select *, case when hist_total_due > 0 then hist_total_paid / hist_total_due else 1.0 end
                  as hist_Loan_Payment_Ratio
        from (select {keys}, sum(paid_amt) as hist_total_paid, sum(due_amt) as hist_total_due,
                     sum(overdue_amt) as hist_total_overdue_amount
              from loan_daily d join {labels} s on {on}
              where d.snapshot_date {compare} s.prediction_date group by {keys})"""


def click_statistics(labels: str, keys: str) -> str:
    if "prediction_date" in keys:
        labels = f"(select distinct Customer_ID, prediction_date from {labels})"
    statistics = [f"avg({c}) as {c}_mean" for c in FE] + [f"stddev_samp({c}) as {c}_std" for c in FE]
    return f"""
        select {keys}, {', '.join(statistics)}
        from clicks c join {labels} s on c.Customer_ID = s.Customer_ID
        where c.snapshot_date <= s.prediction_date group by {keys}"""


def latest(snapshots: str, labels: str, grain: str = "customer") -> str:
    extra, join = ("", "") if grain == "customer" else (", s.prediction_date", ", l.prediction_date")
    return f"""
        select x.*{join} from {snapshots} x join (
            select x.Customer_ID{extra}, max(x.snapshot_date) as latest_day
            from {snapshots} x join {labels} s on x.Customer_ID = s.Customer_ID
            where x.snapshot_date <= s.prediction_date group by x.Customer_ID{extra}) l
        on x.Customer_ID = l.Customer_ID and x.snapshot_date = l.latest_day"""


def gold(grain: str) -> dict[str, str]:
    both = "a.Customer_ID = s.Customer_ID"
    own = "" if grain == "customer" else " and {0}.prediction_date = s.prediction_date"
    loan_keys = "d.Customer_ID" if grain == "customer" else "d.loan_id, d.Customer_ID"
    click_keys = "c.Customer_ID" if grain == "customer" else "c.Customer_ID, s.prediction_date"
    loan_on = "l.Customer_ID = s.Customer_ID" + ("" if grain == "customer" else " and l.loan_id = s.loan_id")
    return {
        "attributes_now": latest("attribute_snapshots", "silver_labels", grain),
        "financials_now": latest("financial_features", "silver_labels", grain),
        "loan_totals": history_sums("silver_labels", loan_keys),
        "click_totals": click_statistics("silver_labels", click_keys),
        "gold": f"""
            select s.*, a.Name, a.Age, a.SSN, a.Occupation, a.snapshot_date, a.year, a.month,
                   f.Credit_History_Age, f.Credit_History_Months, f.Monthly_Surplus,
                   {', '.join('f.' + c for c in [*NUMBERS, *TEXTS, *RATIOS])},
                   {', '.join('l.' + c for c in [*SUMS, 'hist_Loan_Payment_Ratio'])},
                   {', '.join('c.' + c for c in STATISTICS)}
            from silver_labels s
            join attributes_now a on {both}{own.format('a')}
            left join financials_now f on f.Customer_ID = s.Customer_ID{own.format('f')}
            left join loan_totals l on {loan_on}
            left join click_totals c on c.Customer_ID = s.Customer_ID{own.format('c')}""",
    }


GOLD = gold("customer")
GOLD_OUTPUT = f"""
    select * replace ({rounded([*NUMBERS, 'Monthly_Surplus', *SUMS], 4)},
                      {rounded([*RATIOS, 'hist_Loan_Payment_Ratio'], 8)}, {rounded(STATISTICS, 6)})
    from gold"""
CATEGORICAL = ["Occupation", *TEXTS]
NUMERIC = [
    *["Age", "year", "month", *NUMBERS, "Credit_History_Months", "Monthly_Surplus"],
    *[*RATIOS, *SUMS, "hist_Loan_Payment_Ratio", *STATISTICS],
]


def sql(query: str, extra: dict[str, str] | None = None) -> str:
    """A query with the common table expressions it uses, directly or through others."""
    available = {**CTES, **(extra or {})}
    needed: list[str] = []

    def visit(text: str) -> None:
        words = set(text.replace("(", " ").replace(")", " ").replace(",", " ").split())
        for name in available:
            if name in words and name not in needed:
                visit(available[name])
                needed.append(name)

    visit(query)
    if not needed:
        return query
    return "with " + ",\n".join(f"{name} as ({available[name]})" for name in needed) + "\n" + query


SNAPSHOTS = {
    "snapshots": """
        select o_custkey as Customer_ID, cast(o_orderdate as date) as snapshot_date,
               o_totalprice, o_orderpriority from orders""",
}
AMOUNTS = rounded(["loan_amt", "due_amt", "paid_amt", "overdue_amt"], 4)
LOAN_TOTALS = f"select * replace ({rounded(SUMS, 4)}, {rounded(['hist_Loan_Payment_Ratio'], 8)}) from totals"
CLICK_TOTALS = f"select * replace ({rounded(STATISTICS, 6)}) from totals"
DATED = """
    select o_orderkey, {price} as o_totalprice, cast(o_orderdate as date) as snapshot_date,
           cast(year(o_orderdate) as integer) as year, cast(month(o_orderdate) as integer) as month
    from orders"""
MONTHS = "select distinct strftime(prediction_date, '%Y-%m') as pred_month from {0}"
SPLIT = {
    "split_rows": """
        select *, strftime(prediction_date, '%Y-%m') in (
                      select distinct strftime(prediction_date, '%Y-%m') from windows order by 1 desc limit 3)
                  as is_test
        from windows"""
}
CATEGORY_ROWS = {
    "rows_with_gaps": """
        select o_orderkey, o_totalprice, case when o_orderkey % 6 <> 0 then o_orderpriority end as priority,
               case when o_orderkey % 7 <> 0 then o_orderstatus end as status from orders""",
    "priority_order": """
        select priority, row_number() over (order by count(*) desc, priority) - 1 as i
        from rows_with_gaps where priority is not null group by priority""",
    "status_order": """
        select status, row_number() over (order by count(*) desc, status) - 1 as i
        from rows_with_gaps where status is not null group by status""",
    "positions": """
        select r.*, p.i as p, s.i as s, (select count(*) from priority_order) as np,
               (select count(*) from status_order) as ns
        from rows_with_gaps r left join priority_order p using (priority) left join status_order s using (status)""",
}

SHARED = {
    "shared_windows": """
        select *, cast(prediction_date + interval 11 month as date) as label_window_end
        from (select loan_id, Customer_ID, cast(min(loan_start_date) + interval 1 month as date) as prediction_date
              from (select case when loan_id % 11 <> 0 then loan_id end as loan_id, Customer_ID, loan_start_date
                    from (select * from loans
                          union all select loan_id, Customer_ID + 1, loan_start_date from loans where loan_id % 7 = 0))
              group by 1, 2)""",
}
RULE = """
    select o_orderkey, cast(o_orderkey % 4 >= 2 as integer) as label, cast(o_orderkey % 4 >= 2 as integer)::double as prediction
    from orders"""
AHEAD = {
    "ahead_windows": """
        select *, cast(prediction_date + interval 9 month as date) as label_window_end
        from (select loan_id, Customer_ID, cast(min(loan_start_date) + interval 3 month as date) as prediction_date
              from loan_daily where Customer_ID not in (select Customer_ID from flagged) group by 1, 2)""",
    "ahead_labels": """
        select w.Customer_ID, w.loan_id, w.prediction_date,
               case when exists (select 1 from loan_events e
                                 where e.loan_id = w.loan_id and e.overdue_amt > 0
                                   and e.snapshot_date between w.prediction_date and w.label_window_end)
                    then 1 else 0 end as label
        from ahead_windows w""",
    "attributes_ahead": latest("attribute_snapshots", "ahead_labels", "loan"),
}

ORACLES: dict[str, str] = {
    "label_store": sql("select * from labels"),
    "label_store_domain": sql(
        "select * from labels where loan_id in (select loan_id from loan_events)"
    ),
    "loan_info": sql(
        "select loan_id, Customer_ID, min(loan_start_date) as start_date from loan_daily group by 1, 2"
    ),
    "label_window": sql("select loan_id, Customer_ID, start_date, prediction_date, label_window_end from windows"),
    "default_events": sql("select loan_id from defaults"),
    "label_distribution": sql("select label, count(*) as n_loans from labels group by label"),
    "shared_loans": sql(
        """select count(*) as n_shared_loans
           from (select loan_id from windows group by loan_id having count(distinct Customer_ID) > 1)"""
    ),
    "parse_dates": sql("select o_orderkey, snapshot_date from parsed"),
    "bronze_valid_rows": sql(
        """select o_orderkey, snapshot_date, cast(year(snapshot_date) as integer) as year,
                  cast(month(snapshot_date) as integer) as month
           from parsed where snapshot_date is not null"""
    ),
    "bronze_rejects": sql("select o_orderkey, snapshot_date_text from parsed where snapshot_date is null"),
    "partition_distribution": sql(
        """select cast(year(snapshot_date) as integer) as year, cast(month(snapshot_date) as integer) as month,
                  count(*) as n_rows
           from parsed where snapshot_date is not null group by 1, 2 order by 1, 2"""
    ),
    "csv_roundtrip": """
        select c_custkey, case c_custkey % 10 when 0 then null when 1 then null
                               when 2 then 'say "NM", twice' when 3 then 'two' || chr(10) || c_name else ' ' || c_name end as c_name,
               c_nationkey, c_acctbal, c_mktsegment
        from customer""",
    "csv_undeclared_columns": """
        select o_orderkey, case when o_orderkey % 3 <> 0 then o_custkey end as customer, o_totalprice, o_orderpriority,
               case when o_orderkey % 5 <> 0 then o_orderkey end as gaps,
               case when o_orderkey = 1 then 'one' else cast(o_custkey as varchar) end as mostly_numbers,
               cast(o_orderdate as date) as snapshot_date
        from orders""",
    "csv_types_over_batches": """
        select o_orderkey, o_custkey as customer, cast(o_orderdate as date) as snapshot_date,
            case when year(o_orderdate) between 1995 and 1996 then cast(o_orderkey % 7 as double)
                when year(o_orderdate) > 1996 then (o_orderkey % 7) / 2 end as measure,
            case when year(o_orderdate) between 1995 and 1996 then o_orderpriority end as priority,
            case when year(o_orderdate) not between 1995 and 1996 then o_totalprice > 150000 end as large,
            case when year(o_orderdate) > 1996 then o_totalprice end as late
        from orders""",
    "bronze_mirrors_files": """
        select o_orderkey, o_custkey as customer, case when o_orderkey % 7 = 1 then -o_totalprice else o_totalprice end as price,
            o_orderpriority as priority, cast(o_orderdate as date) as snapshot_date,
            case when o_orderkey % 7 = 6 then 'late' end as note,
            cast(year(o_orderdate) as int) as year, cast(month(o_orderdate) as int) as month
        from orders
        where o_orderkey % 7 > 1 or (o_orderkey % 7 = 1 and year(o_orderdate) = 1995)""",
    "bronze_partitioned_roundtrip": DATED.format(price="o_totalprice"),
    "bronze_partition_overwrite": DATED.format(
        price="case when year(o_orderdate) = 1996 and month(o_orderdate) = 6 then -o_totalprice else o_totalprice end"
    ),
    "bronze_months": DATED.format(price="o_totalprice")
    + " where strftime(o_orderdate, '%Y-%m') in ('1996-06', '1997-01')",
    "parquet_roundtrip": "select * from customer",
    "clean_attributes": sql("select * from clean_attributes"),
    "flag_attributes": sql("select * from flagged_attributes"),
    "clean_financials": sql(
        f"select * replace ({', '.join(f'cast({c} as double) as {c}' for c in NUMBERS)}) from clean_financials"
    ),
    "flag_financials": sql("select * from flagged_financials"),
    "flag_loans": sql(f"select * replace ({AMOUNTS}) from flagged_loans"),
    "flagged_customers": sql("select Customer_ID from flagged"),
    "flag_summary": sql(
        """select *, round(100.0 * n_flagged / n_customers, 6) as flagged_percent
           from (select (select count(*) from flagged) as n_flagged,
                        (select count(distinct Customer_ID) from table_ids) as n_customers)"""
    ),
    "remove_flagged_orders": sql(
        "select * from loans where Customer_ID not in (select Customer_ID from flagged)"
    ),
    "remove_flagged_lineitem": sql(
        f"""select * replace ({AMOUNTS}) from loan_daily
            where Customer_ID not in (select Customer_ID from flagged)"""
    ),
    "remove_flagged_split": sql(
        f"""select * replace ({AMOUNTS}) from loan_daily
            where Customer_ID not in (select Customer_ID from flagged)"""
    ),
    "remove_flagged_customer": sql(
        "select * from clean_attributes where Customer_ID not in (select Customer_ID from flagged)"
    ),
    "remove_flagged_events": sql(
        f"""select event_id, Customer_ID, snapshot_date, {rounded(FE, 6)} from clicks
           where Customer_ID not in (select Customer_ID from flagged)"""
    ),
    "removal_counts": sql(
        """select *, rows_before - rows_after as rows_removed
           from (select table_name, count(*) as rows_before,
                        count(*) filter (Customer_ID not in (select Customer_ID from flagged)) as rows_after
                 from table_ids group by table_name)"""
    ),
    "loan_history": sql(
        f"""select e.* replace ({AMOUNTS}), cast(1 as bigint) as n_predictions
            from loan_events e join windows w using (loan_id) where e.snapshot_date <= w.prediction_date"""
    ),
    "loan_history_shared": sql(
        f"""select e.* replace ({AMOUNTS}), count(*) as n_predictions
            from loan_events e join shared_windows w using (loan_id) where e.snapshot_date <= w.prediction_date
            group by all""",
        SHARED,
    ),
    "shared_loans_mapped": sql(
        """select count(*) as n_shared_loans
           from (select loan_id from shared_windows where loan_id is not null
                 group by loan_id having count(distinct Customer_ID) > 1)""",
        SHARED,
    ),
    "default_events_shared": sql(
        """select distinct w.loan_id from shared_windows w join loan_events e on w.loan_id = e.loan_id
           where e.snapshot_date between w.prediction_date and w.label_window_end and e.overdue_amt > 0""",
        SHARED,
    ),
    "lr_scores": RULE,
    "rf_scores": RULE,
    "model_auc": """
        with scored as (
            select o_orderkey * 7 % 10 + case when o_orderkey % 3 = 0 then 2 else 0 end as score,
                   o_orderkey % 3 = 0 as positive from orders),
        levels as (
            select score, count(*) filter (positive) as p, count(*) filter (not positive) as n from scored group by score),
        below as (select *, coalesce(sum(n) over (order by score rows between unbounded preceding and 1 preceding), 0) as lower
                  from levels)
        select 'derived_score' as model, round(sum(p * (lower + n / 2.0)) / (sum(p) * sum(n)), 6)::double as area_under_roc
        from below
        union all select 'logistic_regression', 1.0 union all select 'random_forest', 1.0""",
    "feature_importance": """
        select feature, case when feature = 'level' and n > 1 then 1.0 else 0.0 end::double as importance
        from (select unnest(['level', 'flat', 'kind']) as feature, (select count(distinct o_orderkey % 4) from orders) as n)""",
    "gold_rebuilt_on_change": sql(
        """select s.*, a.Age, a.snapshot_date from ahead_labels s join attributes_ahead a
           on a.Customer_ID = s.Customer_ID and a.prediction_date = s.prediction_date""",
        AHEAD,
    ),
    "loan_agg": sql(LOAN_TOTALS, {"totals": history_sums("windows", "d.Customer_ID")}),
    "loan_agg_stored": sql(LOAN_TOTALS, {"totals": history_sums("windows", "d.Customer_ID")}),
    "loan_agg_loan_grain": sql(LOAN_TOTALS, {"totals": history_sums("windows", "d.loan_id, d.Customer_ID")}),
    "loan_agg_before_prediction": sql(LOAN_TOTALS, {"totals": history_sums("windows", "d.Customer_ID", "<")}),
    "clickstream_history": sql(
        """select c.event_id, c.Customer_ID, c.snapshot_date, count(*) as n_predictions
           from clicks c join windows w on c.Customer_ID = w.Customer_ID
           where c.snapshot_date <= w.prediction_date group by all"""
    ),
    "clickstream_agg": sql(CLICK_TOTALS, {"totals": click_statistics("windows", "c.Customer_ID")}),
    "clickstream_agg_stored": sql(CLICK_TOTALS, {"totals": click_statistics("windows", "c.Customer_ID")}),
    "clickstream_agg_loan_grain": sql(
        CLICK_TOTALS, {"totals": click_statistics("windows", "c.Customer_ID, s.prediction_date")}
    ),
    "asof_customer_grain": sql(latest("snapshots", "windows"), SNAPSHOTS),
    "asof_newest_first": sql(latest("snapshots", "windows"), SNAPSHOTS),
    "asof_max_rejoin": sql(latest("snapshots", "windows"), SNAPSHOTS),
    "asof_running_max": sql(latest("snapshots", "windows"), SNAPSHOTS),
    "asof_loan_grain": sql(latest("snapshots", "windows", "loan"), SNAPSHOTS),
    "credit_history_months": """
        select p_partkey,
               cast(case p_partkey % 10 when 0 then 0 when 1 then p_size % 12 when 2 then 12 * (p_size // 12)
                    else p_size end as integer) as months_plural_only,
               cast(case p_partkey % 10 when 0 then 0 when 2 then 12 * (p_size // 12)
                    else p_size end as integer) as months_any_form
        from part""",
    "financial_ratios": sql(
        f"""select Customer_ID, snapshot_date, Credit_History_Months, {rounded(['Monthly_Surplus'], 4)},
                   {rounded(RATIOS, 8)}
            from financial_features"""
    ),
    "gold_features": sql(GOLD_OUTPUT, GOLD),
    "rebuilt_after_new_months": sql(GOLD_OUTPUT, GOLD),
    "gold_features_loan_grain": sql(GOLD_OUTPUT, gold("loan")),
    "feature_columns": sql(
        f"""select feature, case when feature in ({', '.join(f"'{c}'" for c in CATEGORICAL)})
                            then 'categorical' else 'numeric' end as kind, n_present
            from (select {', '.join(f'count({c}) as {c}' for c in [*CATEGORICAL, *NUMERIC])} from gold)
            unpivot (n_present for feature in ({', '.join([*CATEGORICAL, *NUMERIC])}))""",
        GOLD,
    ),
    "prediction_months": sql(MONTHS.format("windows") + " order by 1"),
    "oot_split": sql(
        """select loan_id, Customer_ID, prediction_date, case when is_test then 'test' else 'train' end as side
           from split_rows""",
        SPLIT,
    ),
    "hash_split": sql(
        """select loan_id, Customer_ID, prediction_date,
                  case when cast('0x' || substr(md5(Customer_ID || '|' || loan_id), 1, 15) as bigint) % 100 < 80
                       then 'train' else 'test' end as side
           from windows"""
    ),
    "impute_median": """
        with leveled as (
            select c_custkey, case when c_custkey % 10 in (1, 2) then 1.0::double
                                   when c_custkey % 10 in (3, 4, 5, 6) then 2.5::double
                                   when c_custkey % 10 in (7, 8, 9) then 4.0::double end as level
            from customer)
        select c_custkey, level, coalesce(level, (select quantile_disc(level, 0.5) from leveled)) as filled
        from leveled""",
    "string_index_distributed": sql(
        """select o_orderkey, priority, status, format('{:012d}', o_orderkey) as own,
                  cast(coalesce(p, np) as double) as priority_idx, cast(coalesce(s, ns) as double) as status_idx,
                  cast(row_number() over (order by o_orderkey) - 1 as double) as own_idx
           from positions""",
        CATEGORY_ROWS,
    ),
    "sparse_features": sql(
        """select o_orderkey, slot, value from (
               select o_orderkey, unnest([p, np + s, np + ns + place, np + ns + n]) as slot,
                      unnest([1.0, 1.0, 1.0, o_totalprice]::double[]) as value
               from (select *, row_number() over (order by o_orderkey) - 1 as place, count(*) over () as n from positions))
           where slot is not null and value <> 0""",
        CATEGORY_ROWS,
    ),
    "exact_medians": """
        with columns as (
            select o_totalprice, case when o_orderkey % 3 <> 0 then -o_totalprice * o_totalprice end as squared,
                o_orderkey::double as key, (o_orderkey % 4)::double as level from orders),
        long as (unpivot columns on o_totalprice, squared, key, level into name feature value v),
        ranked as (
            select feature, v, row_number() over (partition by feature order by v) as place, count(*) over (partition by feature) as n
            from long)
        select feature, q, v as value from ranked, (select unnest([0.5, 0.9])::double as q) where place = ceil(q * n)""",
    "auc_exact": """
        with scored as (
            select floor(l_extendedprice) + case when l_returnflag = 'R' then 500 else 0 end as score,
                l_returnflag = 'R' as positive from lineitem),
        levels as (
            select score, count(*) filter (positive) as p, count(*) filter (not positive) as n from scored group by score),
        below as (select *, coalesce(sum(n) over (order by score rows between unbounded preceding and 1 preceding), 0) as lower
                  from levels)
        select round(sum(p * (lower + n / 2.0)) / (sum(p) * sum(n)), 9)::double as area_under_roc,
            sum(p)::bigint as positives, sum(n)::bigint as negatives from below""",
    "string_index": sql(
        """select o_orderkey, priority, status, cast(coalesce(p, np) as double) as priority_idx,
                  cast(coalesce(s, ns) as double) as status_idx
           from positions""",
        CATEGORY_ROWS,
    ),
    "one_hot": sql(
        """select o_orderkey, cast(np as integer) as priority_width, cast(coalesce(p, -1) as integer) as priority_slot,
                  cast(ns as integer) as status_width, cast(coalesce(s, -1) as integer) as status_slot
           from positions""",
        CATEGORY_ROWS,
    ),
    "assemble_features": sql(
        """select * from (
               select o_orderkey, cast(np + ns + 1 as integer) as width, cast(slot as integer) as slot,
                      case when slot = np + ns then o_totalprice
                           when slot = p or slot = np + s then 1.0 else 0.0 end::double as value
               from (select *, unnest(range(np + ns + 1)) as slot from positions))
           where value <> 0""",
        CATEGORY_ROWS,
    ),
    "model_save_load": sql(
        """select count(*) as n_scored, cast(0 as bigint) as n_different from gold
           where strftime(prediction_date, '%Y-%m') in (
               select distinct strftime(prediction_date, '%Y-%m') from gold order by 1 desc limit 3)""",
        GOLD,
    ),
}
