"""Facts, pages and failures out of the star schema's tables, as SQL that Spark and DuckDB both read.

Publishers are order priorities, entities customers, and periods years, so facts, pairs and relations grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "pages", "labels", "conversations"]

#: Order values by customer, publisher, status and year. Names of attributes and entities differ between publishers.
ORDER_FACTS = """
select (o_custkey * 10 + p) * 400 + (y - 1990) * 4 + s as id, o_orderpriority as document_id,
       case when p = 3 then lpad(cast(o_custkey as varchar(12)), 9, '0') || ' customer group' else lpad(cast(o_custkey as varchar(12)), 9, '0') || ' customer' end as entity_key,
       case when p = 5 and o_custkey % 7 = 0 then 'count return' when p = 3 then 'order value' when p = 4 then 'gross order total value'
            when p = 5 then 'order placed total value' else 'order total value' end as attribute_key,
       case when p = 5 and o_custkey % 7 = 0 then 'Return count' when p = 3 then 'Value of orders' when p = 4 then 'Gross total value of orders'
            when p = 5 then 'Total value of orders placed' when p = 2 then 'Orders, total value' else 'Total value of orders' end as attribute,
       'Customer#' || lpad(cast(o_custkey as varchar(12)), 9, '0') as entity,
       floor(v / 50000) * cast(50000 as double) as value_num, 'USD' as unit,
       case when o_custkey % 13 = 0 and y % 3 = 0 then 'unknown' else cast(y as varchar(4)) || '-01-01:' || cast(y as varchar(4)) || '-12-31' end as period_key,
       case s when 0 then 'actual' when 1 then 'provisional' else 'projection' end as estimate_type,
       case p when 4 then 'constant price' when 5 then 'current price' else '' end as basis_key,
       case when p = 2 and o_custkey % 4 = 0 then 'agency' end as attributed_to,
       o_custkey % 5 <> 0 as evidence_verified,
       case p when 1 then date '2001-01-30' when 2 then date '2001-05-29' when 3 then date '2001-05-29' when 4 then date '2001-09-01' end as publication_date,
       'total of ' || cast(y as varchar(4)) as quote, o_custkey % 11 = 0 and s = 2 as is_duplicate
from (select o_custkey, o_orderpriority, cast(substr(o_orderpriority, 1, 1) as int) as p, year(o_orderdate) as y,
             case o_orderstatus when 'F' then 0 when 'P' then 1 else 2 end as s, cast(sum(cast(o_totalprice as decimal(18, 2))) as double) as v
      from orders group by o_custkey, o_orderpriority, o_orderstatus, year(o_orderdate)) as base
"""

#: The publishers.
PUBLISHERS = """
select o_orderpriority as document_id, o_orderpriority || '.pdf' as filename, 'Bulletin ' || o_orderpriority as title, 'extracted' as status,
       case substr(o_orderpriority, 1, 1) when '1' then date '2001-01-30' when '2' then date '2001-05-29' when '3' then date '2001-05-29' when '4' then date '2001-09-01' end as publication_date
from orders group by o_orderpriority
"""

#: Quantities of a customer's year by return flag, one publisher each, and totals by two more.
QUANTITY_FACTS = """
select (o_custkey * 100 + (y - 1990)) * 10 + k as id, case k when 0 then 'A-book' when 1 then 'N-book' when 2 then 'R-book' else 'totals' end as document_id,
       lpad(cast(o_custkey as varchar(12)), 9, '0') || ' customer' as entity_key,
       case k when 0 then 'accepted quantity' when 1 then 'new quantity' when 2 then 'quantity returned' when 3 then 'quantity settled' else 'quantity total' end as attribute_key,
       cast(q as double) as value_num, 'count' as unit, cast(y as varchar(4)) || '-01-01:' || cast(y as varchar(4)) || '-12-31' as period_key
from (select o_custkey, y, k, case k when 0 then a when 1 then n when 2 then r when 3 then a + r else a + n + r end as q
      from (select *, unnest([0, 1, 2, 3, 4]) as k
            from (select o_custkey, year(o_orderdate) as y, sum(case when l_returnflag = 'A' then cast(l_quantity as bigint) else 0 end) as a,
                         sum(case when l_returnflag = 'N' then cast(l_quantity as bigint) else 0 end) as n, sum(case when l_returnflag = 'R' then cast(l_quantity as bigint) else 0 end) as r
                  from orders join lineitem on l_orderkey = o_orderkey group by o_custkey, year(o_orderdate)) as sums) as kinds) as each
where q > 0
"""

#: Documents as pages of their source.
PAGES = """
select source as document_id, doc_id as page_index, coalesce(text, '') || chr(10) || case when doc_id % 3 = 0 then cast(doc_id % 400 as varchar(4)) when doc_id % 3 = 1 then 'Page ' || cast(doc_id % 90 as varchar(4)) else 'xiv' end as text,
       case doc_id % 7 when 0 then 'pending' when 1 then 'processing' when 2 then 'failed' when 3 then 'skipped' else 'done' end as status,
       cast(doc_id % 5 as int) as attempts
from documents
"""

#: Errors of the event stream as failures.
FAILURES = """
select event_id as id, case user_id % 3 when 0 then 'extract' when 1 then 'verify' else 'validate' end as stage,
       case user_id % 3 when 0 then 'llm_json' when 1 then 'quote_not_found' else 'validator' end as kind,
       case user_id % 6 when 0 then '1-URGENT' when 1 then '2-HIGH' when 2 then '3-MEDIUM' when 3 then '4-NOT SPECIFIED' when 4 then '5-LOW' end as document_id
from events where event_type = 'error'
"""


def load(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of one of the statements above, over the tables of a folder."""
    named = [t for t in TABLES if f" {t} " in sql.replace("\n", " ").replace(",", " ") + " "]
    sql = sql.replace("unnest([0, 1, 2, 3, 4])", "explode(array(0, 1, 2, 3, 4))")
    return spark.sql("with " + ", ".join(f"{t} as (select * from parquet.`{sf_dir}/{t}.parquet`)" for t in named) + f" select * from ({sql})")
