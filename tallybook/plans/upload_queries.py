"""Registered queries of the upload path: routing by file, stored uploads, files, sinks, pages and streams.

They continue ``catalog.py``; the SQL beside them continues ``oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybook.functions.dates import with_distinct_dates
from tallybook.operators import basic_extract as X
from tallybook.operators import layout_extract as L
from tallybook.operators import responses as R
from tallybook.operators import store, views
from tallybook.operators.validate import validate_invoices
from tallybook.plans import catalog
from tallybook.plans import expected as P
from tallybook.plans import oracle as O
from tallybook.plans.catalog import AS_OF
from tallybook.plans.documents import process_uploads, upload_records
from tallybook.session import shared_folder
from tallybook.sources import derived as D
from tallybook.sources import invoice_json as J
from tallybook.sources.files import read_invoice_files
from tallybook.sources.json_arrays import read_json_records
from tallybook.sources.tables import table
from tallybook.streaming import intake

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


# ---- routing ------------------------------------------------------------------------------------


def _uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Every file of the orders, asked for by different methods, some of which fail."""
    invoices = D.invoices(spark, folder)
    parsed = R.parse_responses(D.responses(invoices), fences="anywhere").withColumnRenamed("invoice_id", "file_id")
    model = parsed.withColumn("error", F.when(~F.col("parsed"), "Malformed JSON")).drop("parsed")
    texts = D.invoice_text(invoices).withColumnRenamed("invoice_id", "file_id")
    return process_uploads(D.uploads(spark, folder), texts, AS_OF, D.document_answers(invoices), model)


@query
def rt_documents_auto(spark: SparkSession, folder: str) -> DataFrame:
    return _uploads(spark, folder).select(
        "file_id", "file_type", "method_requested", "model_used", "confidence", "extraction_error", "success", "error",
        "invoice_number", "vendor_name", "total_amount", "is_valid", "score", F.size("errors").alias("n_errors"),
    )


@query
def rt_store(spark: SparkSession, folder: str) -> DataFrame:
    stored = upload_records(_uploads(spark, folder), "2000-06-30 12:00:00")
    return stored.select(
        "invoice_id", "file_id", "file_name", "file_type", "invoice_number", "currency", "is_valid", "validation_score",
        F.col("extraction_metadata.method_requested").alias("method_requested"),
        F.col("extraction_metadata.model_used").alias("model_used"),
        F.col("extraction_metadata.error").alias("extraction_error"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
    )


# The messages of the single intake differ from those of a batch only in the size limit.
_GATED = O.GATED.replace("concat('File size (', printf('%.2f', length/1048576.0), 'MB) exceeds 35MB limit')", "'File size exceeds 35MB limit'")
_FIELDS = "invoice_number, vendor_name, buyer_name, invoice_date, due_date, currency, total_amount, subtotal, tax_amount".split(", ")


def _chosen(field: str) -> str:
    model = f"try_cast(m.{field} as double)" if field in ("total_amount", "subtotal", "tax_amount") else f"m.{field}"
    return f"case used when 'document' then i.{field} when 'model' then {model} else e.{field} end {field}"


UPLOADS = f"""{O.TXT}, {O.EXTRACTED}, {O.RESPONSES}, {_GATED},
asked as (select *, error is null and file_type='pdf' readable, file_id k,
  case file_id%5 when 0 then 'auto' when 1 then 'google_document_ai' when 2 then 'gemini_extraction' when 3 then 'pdf_extractor'
    else 'something' end requested, (file_id//12)%2=0 document_ready, (file_id//6)%3<>1 model_ready,
  file_id%7>=3 and file_id%11<>0 document_ok, file_id%4 in (0,1) model_ok,
  case when file_id%11=0 then 'No answer' else concat('503 quota exceeded for file ', file_id) end document_error from gated),
turn as (select *, case when requested='auto' and document_ready then 'document first' when requested='auto' and model_ready then 'model first'
    when requested='auto' then 'local' when requested='google_document_ai' then 'document' when requested='gemini_extraction' then 'model'
    when requested='pdf_extractor' then 'local' else 'default' end way from asked),
went as (select *, case when way in ('document first', 'document') and document_ok then 'document'
    when way in ('model first', 'model') and model_ok then 'model'
    when way='document first' and model_ready and model_ok then 'model' else 'local' end used from turn),
told as (select *, case when not readable then case when error is null then 'unknown' end
    when used='document' then 'Google Document AI' when used='model' and way='document first' then 'Gemini Extraction (Fallback)'
    when used='model' then 'Gemini Extraction' when way='local' then 'PDF Extractor (Regex)' when way='default' then 'PDF Extractor (Default)'
    when way='document first' and not model_ready then 'PDF Extractor (Fallback)' else 'PDF Extractor (Emergency Fallback)' end model_used from went),
src as (select file_id invoice_id, {", ".join(_chosen(f) for f in _FIELDS)}, cast(null as double) items_total
  from told left join inv i on i.invoice_id=file_id left join rsp m on m.invoice_id=file_id left join ext e on e.invoice_id=file_id
  where readable),
{O.rules("src").strip()},
done as (select t.*, v.* exclude (invoice_id, i, u), case model_used when 'Google Document AI' then 95.0::double when 'Gemini Extraction' then 90.0
    when 'Gemini Extraction (Fallback)' then 85.0 when 'PDF Extractor (Regex)' then 70.0 when 'PDF Extractor (Fallback)' then 60.0
    else case when error is null then 0.0 end end confidence,
  case when readable and model_used='PDF Extractor (Emergency Fallback)' then case when way in ('document first') then 'Malformed JSON'
    when way='document' then document_error else 'Malformed JSON' end end extraction_error
  from told t left join val v on v.invoice_id=t.file_id)"""
ORACLE["rt_documents_auto"] = f"""with {UPLOADS} select file_id, file_type, requested method_requested, model_used, confidence, extraction_error,
  error is null success, error, invoice_number, vendor_name, total_amount,
  case when readable then is_valid when error is null then false end is_valid, case when readable then score when error is null then 0 end score,
  cast(case when readable then len(errors) when error is null then 1 end as integer) n_errors from done"""
ORACLE["rt_store"] = f"""with {UPLOADS} select file_id invoice_id, file_id, file_name, file_type, invoice_number,
  coalesce(nullif(currency,''),'USD') currency, coalesce(readable and is_valid, false) is_valid,
  cast(case when readable then score else 0 end as integer) validation_score, requested method_requested, model_used, extraction_error,
  '2000-06-30 12:00:00' created_at from done where error is null"""


# ---- every label --------------------------------------------------------------------------------


@query
def x_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Basic extraction from texts that use every label."""
    fields = "invoice_number buyer_name buyer_address invoice_date due_date total_amount subtotal tax_amount payment_terms".split()
    return X.extract_basic(D.label_texts(spark, folder)).select("invoice_id", "vendor_name", "currency", *fields)


@query
def lx_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Layout extraction from text alone, of texts that use every label."""
    found = L.extract_layout(D.label_texts(spark, folder))
    fields = "invoice_number vendor_name buyer_name invoice_date due_date currency subtotal tax_amount total_amount".split()
    return found.select("invoice_id", *fields, F.col("source")["buyer_name"].alias("buyer_source"))


def _listed(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("\n", "' || chr(10) || '") + "'" for v in values) + "]"


_n, _m = len(D.LABEL_KINDS), len(D.SEPARATORS)
_days = " ".join(
    f"when {i} then strftime(o_orderdate, '{f}')" for i, f in enumerate(["%Y-%m-%d", "%d/%m/%Y", "%d-%m-%Y", "%-d %b %Y", "%-d.%-m.%Y"])
)
LABELLED = f"""
lab as (select *, {_listed([x for x, _ in D.LABEL_KINDS])}[o_orderkey%{_n}+1] label, {_listed([x for _, x in D.LABEL_KINDS])}[o_orderkey%{_n}+1] kind,
  {_listed(D.SEPARATORS)}[o_orderkey//{_n}%{_m}+1] sep, o_orderkey//{_n * _m} form, cast(cast(o_totalprice as decimal(18,2)) as varchar) figure from orders),
txt as (select o_orderkey invoice_id, concat('Trader ', o_orderkey, chr(10), '8 Hill Street', chr(10), label, sep,
  case kind when 'number' then concat(o_orderkey, '-A')
    when 'name' then concat('Buyer Nr. ', o_orderkey, chr(10), '7 Lake Road', chr(10), '12345 Town', chr(10))
    when 'date' then case form%{len(D.DATE_FORMS)} {_days} end
    when 'amount' then concat({_listed(D.CURRENCY_SIGNS)}[form%{len(D.CURRENCY_SIGNS)}+1], figure)
    else concat('30 days from ', strftime(o_orderdate, '%Y-%m-%d')) end, chr(10), 'end', chr(10)) t from lab)"""
ORACLE["x_labels"] = f"""with {LABELLED} select invoice_id, {O.X_NUMBER} invoice_number, {O.X_VENDOR} vendor_name, {O.X_BUYER} buyer_name,
  {O.strip(O.first('t', P.BUYER_ADDRESS))} buyer_address, {O.date_after('t', P.INVOICE_DATE_LINE)} invoice_date,
  {O.date_after('t', P.DUE_DATE_LINE)} due_date, {O.X_CURRENCY} currency, {O.X_TOTAL} total_amount, {O.X_SUBTOTAL} subtotal,
  {O.X_TAX} tax_amount, {O.strip(O.first('t', [p for p, _ in P.PAYMENT_TERMS], [g for _, g in P.PAYMENT_TERMS]))} payment_terms from txt"""
_lx = f"""with {LABELLED}, {O.LX_AMOUNTS}, {O.LX_LINES},
  c0 as (select invoice_id, t, {O.LX_NUMBER} l_number, {O.grab('t', P.PLAIN_NUMBER, 1, False)} p_number, {O.LX_BUYER} l_buyer, {O.LX_FALLBACK_BUYER} f_buyer,
    {O.first_line('t', P.FALLBACK_VENDOR_STOP_WORDS, 3, 1000000000)} vendor_name, {O.layout_iso('i_line')} invoice_date, {O.layout_iso('d_line')} due_date,
    nullif(total,0) total0, nullif(sub,0) sub0, nullif(tax,0) tax0, cast(null as varchar) tax_src, cast(null as varchar) sub_src
    from lxa join lxl using (invoice_id, t)), {O.COMPUTED}
  select invoice_id, coalesce(nullif(l_number,''), p_number) invoice_number, vendor_name,
  coalesce(nullif(l_buyer,''), case when length(f_buyer)>3 then f_buyer end) buyer_name,
  case when nullif(l_buyer,'') is not null then 'layout' when length(f_buyer)>3 then 'heuristic' end buyer_source,
  nullif(invoice_date,'') invoice_date, nullif(due_date,'') due_date,
  case when contains(t,'$') or contains(t,'USD') then 'USD' when contains(t,'€') or contains(t,'EUR') then 'EUR' end currency,
  sub1 subtotal, tax1 tax_amount, total0 total_amount from c2"""
ORACLE["lx_labels"] = _lx


@query
def lx_net(spark: SparkSession, folder: str) -> DataFrame:
    """Layout extraction of texts without a subtotal, which follows from total and tax."""
    found = L.extract_layout(D.net_texts(spark, folder))
    money = [F.col(c).cast("decimal(18,2)").cast("string").alias(c) for c in ("total_amount", "subtotal", "tax_amount")]
    return found.select("invoice_id", *money, F.col("source")["subtotal"].alias("subtotal_source"))


_net = """
net as (select o_orderkey invoice_id, cast(o_totalprice as decimal(18,2)) m from orders),
txt as (select invoice_id, concat('Total: $', m, chr(10), case when invoice_id%2=0 then 'VAT ' else 'Tax: €' end,
  cast(case when invoice_id%5=0 then m+1 else round(m*0.1, 2) end as decimal(18,2)), chr(10),
  case when invoice_id%7=0 then concat('Zwischensumme ', cast(m-3 as decimal(18,2))) else '' end) t from net)"""
ORACLE["lx_net"] = f"""with {_net}, {O.LX_AMOUNTS},
  c0 as (select invoice_id, nullif(total,0) total0, nullif(sub,0) sub0, nullif(tax,0) tax0,
    case when nullif(tax,0) is not null then 'layout' end tax_src, case when nullif(sub,0) is not null then 'layout' end sub_src from lxa),
  {O.COMPUTED}
  select invoice_id, {O.money('total0')} total_amount, {O.money('sub1')} subtotal, {O.money('tax1')} tax_amount, sub_src1 subtotal_source from c2"""


@query
def n_lenient_date(spark: SparkSession, folder: str) -> DataFrame:
    """Dates in unusual words, each different text read once."""
    as_of = F.lit(AS_OF).cast("date")
    read = with_distinct_dates(D.unusual_dates(spark, folder), "parsed", "text", as_of)
    return read.select("invoice_id", F.col("parsed.day").alias("day"), F.col("parsed.tod").alias("tod"))


ORACLE["n_lenient_date"] = f"""with s as (select o_orderkey invoice_id, o_orderkey%6 shape, cast(o_orderdate as date) d, {O.AS_OF} a from orders)
  select invoice_id, case when shape in (0, 2, 3, 4) then d
    when shape=1 then make_date(year(a), month(d), least(day(a), day(last_day(make_date(year(a), month(d), 1))))) end as day,
  case when shape=3 then 49500000000 else 0 end::bigint tod from s"""


# ---- merges -------------------------------------------------------------------------------------


@query
def m_mismatches(spark: SparkSession, folder: str) -> DataFrame:
    merged = catalog._merged(spark, folder)
    return merged.select("invoice_id", "mismatch_count", F.array_join("mismatches", " | ").alias("mismatches"))


@query
def m_result(spark: SparkSession, folder: str) -> DataFrame:
    """The whole row of a merge: merged fields, both inputs, both sources and the account of the comparison."""
    return catalog._merged(spark, folder).select(
        "invoice_id", "invoice_number", "vendor_name", "total_amount", "quality_score", "recommendation", "merge_timestamp",
        F.size("field_comparisons").alias("n_comparisons"), F.array_join("notes", " ").alias("notes"),
        F.col("pdf_data.vendor_name").alias("pdf_vendor"), F.col("google_data.vendor_name").alias("google_vendor"),
        F.col("pdf_source.source_type").alias("pdf_type"), F.col("google_source.source_type").alias("google_type"),
        F.col("pdf_source.is_complete").alias("pdf_complete"), F.col("google_source.timestamp").alias("google_at"),
    )


# Of two texts the longest common part, the first of equally long ones in the left and then in the right, matches; and
# so on with what is left of it and what is right of it. Twice the matched characters over all is the similarity.
_part = """list_max(flatten(list_transform(range(al, ah), lambda i: list_transform(range(bl, bh), lambda j: {
  'k': len(list_filter(range(1, least(ah-i, bh-j)+1), lambda n: substr(l, (i+1)::int, n::int) = substr(r, (j+1)::int, n::int))), 'i': -i, 'j': -j}))))"""
RATIOS = f"""
texts as (select distinct lower(vendor_name) l, lower(r_vendor) r from pair where lower(vendor_name)<>lower(r_vendor)),
parts as (select l, r, 0::bigint al, length(l) ah, 0::bigint bl, length(r) bh from texts),
grown as (
  select l, r, al, ah, bl, bh, {_part} m from parts
  union all
  select l, r, al, ah, bl, bh, {_part} from (
    select l, r, unnest([al, -m.i + m.k]) al, unnest([-m.i, ah]) ah, unnest([bl, -m.j + m.k]) bl, unnest([-m.j, bh]) bh
    from grown where m.k > 0) where al < ah and bl < bh),
ratios as (select l, r, 200.0::double * sum(m.k) / (length(l) + length(r)) percent from grown group by l, r)"""
_vendor_reason = """case when lower(vendor_name)=lower(r_vendor) then 'Similar values (similarity=100.0%), preferring Google'
  when percent/100 <= 0.85 then printf('Different values (similarity=%.1f%%), using Google', percent)
  else printf('Similar values (similarity=%.1f%%), preferring Google', percent) end"""
_vendor_differs = "lower(vendor_name)<>lower(r_vendor) and percent/100 <= 0.85"
RATED = f"recursive {O.MERGED.strip()}, {RATIOS}, rated as (select pair.*, percent from pair left join ratios on l=lower(vendor_name) and r=lower(r_vendor))"
_same = " union all ".join(
    f"select invoice_id, '{f}' field_name, {f} selected_value, 'Similar values (similarity=100.0%), preferring Google' selection_reason, "
    f"{w}::double confidence_score, false is_mismatch from rated where trim({f})<>''"
    for f, w in (("invoice_number", 95.0), ("invoice_date", 95.0), ("due_date", 90.0), ("currency", 95.0))
)
ORACLE["m_text"] = f"""with {RATED}
  select invoice_id, 'vendor_name' field_name, r_vendor selected_value, {_vendor_reason} selection_reason, 90.0::double confidence_score,
    {_vendor_differs} is_mismatch from rated where trim(vendor_name)<>'' and trim(r_vendor)<>''
  union all select invoice_id, 'buyer_name', r_buyer, 'Similar values (similarity=100.0%), preferring Google', 90.0::double, false
    from rated where trim(buyer_name)<>'' and trim(r_buyer)<>''
  union all {_same}"""
_total = f"""concat('total_amount: PDF=', l::varchar, ', Google=', r::varchar, ', Selected=', r::varchar, ' (Google preferred (Google=', r::varchar,
  ', PDF=', l::varchar, ', diff=', printf('%.1f', {O.DIFF}), '%))')"""
_items = """concat('line_items: PDF=', item_count, ', Google=', r_items, ', Selected=', r_items,
  ' (PDF has more items, still using Google (Google=', r_items, ', PDF=', item_count, '))')"""
_listed_mismatches = f"""list_filter([
  case when {_vendor_differs} then concat('vendor_name: PDF=', vendor_name, ', Google=', r_vendor, ', Selected=', r_vendor, ' (', {_vendor_reason}, ')') end,
  case when l is not null and r is not null and {O.DIFF}>5 then {_total} end,
  case when r_items>0 and item_count>r_items then {_items} end], lambda x: x is not null)"""
ORACLE["m_mismatches"] = f"""with {RATED}, a as (select *, total_amount l, r_total r from rated), m as (select invoice_id, {_listed_mismatches} ms from a)
  select invoice_id, cast(len(ms) as integer) mismatch_count, array_to_string(ms, ' | ') mismatches from m"""
ORACLE["m_result"] = f"""with q as ({O.ORACLE["m_quality"]}), {O.MERGED.strip()}
  select invoice_id, nullif(invoice_number,'') invoice_number, coalesce(r_vendor, vendor_name) vendor_name, coalesce(r_total, total_amount) total_amount,
  quality_score, recommendation, '{AS_OF}T00:00:00' merge_timestamp, 13 n_comparisons, note notes, vendor_name pdf_vendor, r_vendor google_vendor,
  'pdf_local' pdf_type, 'google_vision' google_type, pdf_fields>=8 pdf_complete, '{AS_OF}T00:00:00' google_at
  from pair join q using (invoice_id)"""


# ---- streams ------------------------------------------------------------------------------------


@query
def ss_dedup_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Uploads arrive as files in disturbed order and are decided as they arrive.

    Eight spans of time arrive one after the other; within a span, files hold different names and come in any order.
    """
    uploads = D.uploads_from_events(table(spark, folder, "events"))
    target = shared_folder(spark, "arriving")
    second = F.col("ts").cast("timestamp").cast("long")
    low, high = uploads.agg(F.min(second), F.max(second)).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // 8))
    for span in range(8):
        part = uploads.where(F.floor((second - F.lit(low)) / F.lit(width)) == span)
        part.repartition(3, "file_name").write.mode("append").parquet(target)
    arriving = spark.readStream.schema(uploads.schema).option("maxFilesPerTrigger", 2).parquet(target)
    out = shared_folder(spark, "accepted")
    decided = intake.suppress_duplicates(arriving, horizon=f"{width} seconds")
    intake.append_available(decided, f"{out}/table", f"{out}/checkpoint")
    moment = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts")
    return spark.read.parquet(f"{out}/table").select("file_name", moment, "late")


ORACLE["ss_dedup_stream"] = O.ORACLE["ss_dedup"].replace(" ts from accepted", " ts, false late from accepted")


@query
def ss_validate_json(spark: SparkSession, folder: str) -> DataFrame:
    """Invoices arrive as JSON files, a record or an array each, and are validated and appended to a table."""
    records = shared_folder(spark, "arriving")
    catalog.json_records(spark, folder).select("record").write.option("lineSep", "\n").text(records)
    stream = spark.readStream.option("maxFilesPerTrigger", 3).text(records)
    validated = intake.validate_stream(J.load_invoices(stream, "value"), AS_OF)
    out = shared_folder(spark, "validated")
    rows = validated.select("invoice_number", "vendor_name", "is_valid", "score", "load_error")
    intake.append_available(rows, f"{out}/table", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/table")


_GOOD = "load_error is null"
ORACLE["ss_validate_json"] = f"""with {O.RECORDS}, {O.rules('rec')} select load_error,
  case when {_GOOD} then invoice_number end invoice_number, case when {_GOOD} then vendor_name end vendor_name,
  is_valid and {_GOOD} is_valid, case when {_GOOD} then score end score from val"""


@query
def ag_dashboard_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """The dashboard of validated invoices that arrive as files, added up batch by batch."""
    arriving, sums = shared_folder(spark, "arriving"), shared_folder(spark, "sums")
    validated = validate_invoices(D.invoices(spark, folder), AS_OF)
    kept = validated.select("is_valid", "score", "errors", "total_amount")
    kept.repartition(8).write.parquet(arriving)
    stream = spark.readStream.schema(kept.schema).option("maxFilesPerTrigger", 3).parquet(arriving)
    intake.append_summaries(stream, sums, shared_folder(spark, "checkpoint"))
    return intake.summed_dashboard(spark, sums)


ORACLE["ag_dashboard_incremental"] = O.ORACLE["ag_dashboard"]


# ---- files --------------------------------------------------------------------------------------


@query
def src_json_file(spark: SparkSession, folder: str) -> DataFrame:
    """Invoices from JSON files that are one array each, some of them cut short or with a comma too many."""
    target = shared_folder(spark, "arrays")
    key = F.col("invoice_id")
    records = catalog.json_records(spark, folder).where((key % 13 != 0) & (key % 7 != 0))
    in_file = Window.partitionBy("bundle").orderBy("invoice_id")
    rows = records.withColumn("bundle", (key % 10).cast("int")).withColumns(
        {"first": F.row_number().over(in_file) == 1, "last": F.lead("invoice_id").over(in_file).isNull()}
    )
    close = F.when(F.col("bundle") == 3, "").when(F.col("bundle") == 8, ",]").otherwise("]")
    line = F.concat(
        F.when(F.col("first"), "[").otherwise(""), "record", F.when(F.col("last"), close).otherwise(",")
    ).alias("value")
    rows.repartition("bundle").sortWithinPartitions("bundle", "invoice_id").select("bundle", line).write.option(
        "lineSep", " "
    ).partitionBy("bundle").text(target)
    texts = read_json_records(spark, f"{target}/bundle=*")
    bundle = F.regexp_extract("file", "bundle=([0-9]+)", 1).cast("int")
    loaded = J.load_invoices(texts.select(bundle.alias("bundle"), "value"), "value")
    return loaded.select("bundle", "invoice_number", "vendor_name", "load_error")


ORACLE["src_json_file"] = f"""with {O.RECORDS}, r as (select *, cast(invoice_id%10 as integer) bundle from rec
  where invoice_id%13<>0 and invoice_id%7<>0)
  select bundle, case when {_GOOD} then invoice_number end invoice_number, case when {_GOOD} then vendor_name end vendor_name, load_error
  from r where bundle not in (3, 8)
  union all select bundle, null, null, 'Malformed JSON' from r where bundle in (3, 8) group by bundle"""


def _reports(spark: SparkSession, folder: str) -> str:
    """A folder of real files: the invoices of each customer's nation as one text, twice over."""
    target = shared_folder(spark, "reports")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, folder, "orders").join(customers, F.col("c_custkey") == F.col("o_custkey"))
    lines = orders.select("c_nationkey", "o_orderkey", F.concat(F.lit("INV-"), F.col("o_orderkey").cast("string")).alias("value"))
    for copy in ("first", "second"):
        # A file is written by one task, in the order of its invoices.
        rows = lines.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "o_orderkey")
        rows.select("c_nationkey", "value").write.partitionBy("c_nationkey").text(f"{target}/{copy}")
    return target


@query
def src_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files read with their bytes and stored by content; the second time nothing is added."""
    files = read_invoice_files(spark, _reports(spark, folder), pattern="*.txt", nested=True)
    kept = store.FileStore(spark, shared_folder(spark, "store"))
    kept.put(files)
    again = kept.put(files)
    found = kept.get(again.select("file_id"))
    n_contents = kept.contents.count()
    return found.groupBy("content_id", "length").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.min(F.sha2("content", 256) == F.col("content_id")).alias("intact"),
        F.min(F.length("content") == F.col("length")).alias("whole"),
        F.max("content_type").alias("content_type"),
        F.lit(n_contents).alias("n_contents"),
    )


ORACLE["src_files"] = """with t as (select c_nationkey, string_agg(concat('INV-', o_orderkey, chr(10)), '' order by o_orderkey) as body
    from orders join customer on c_custkey=o_custkey group by 1)
  select sha256(body) content_id, strlen(body)::bigint length, 2::bigint n_files, true intact, true whole,
  'application/octet-stream' content_type, (select count(distinct body) from t) n_contents from t"""


@query
def snk_json(spark: SparkSession, folder: str) -> DataFrame:
    """Results written as JSON arrays and read again; failed extractions are left out."""
    target = shared_folder(spark, "results")
    validated = validate_invoices(D.invoices(spark, folder), AS_OF)
    failed = F.when(F.col("invoice_id") % 9 == 0, "no text")
    money = F.col("total_amount").cast("decimal(18,2)").cast("string").alias("total_amount")
    rows = validated.select("invoice_id", "invoice_number", "vendor_name", money, "score", "errors", failed.alias("error"))
    views.write_results_json(rows, target, arrays=True)
    fields = "invoice_id long, invoice_number string, vendor_name string, total_amount string, score int, errors array<string>, error string"
    texts = read_json_records(spark, target).withColumn("record", F.explode(F.from_json("value", f"array<struct<{_typed(fields)}>>")))
    return texts.select("record.*").withColumn("errors", F.array_join("errors", " | "))


def _typed(fields: str) -> str:
    return ", ".join(f.replace(" ", ": ", 1) for f in fields.split(", "))


ORACLE["snk_json"] = f"""with {O.VAL} select invoice_id, invoice_number, vendor_name, {O.money('total_amount')} total_amount, score,
  array_to_string(errors, ' | ') errors, cast(null as varchar) error from val where invoice_id%9<>0"""


@query
def snk_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The field-value form of every invoice written as CSV and read again."""
    target = shared_folder(spark, "csv")
    views.write_field_value_csv(views.to_field_value(D.invoices(spark, folder)), target)
    lines = spark.read.option("header", True).option("escape", '"').schema("invoice_id long, position int, Field string, Value string")
    return lines.csv(target).withColumn("Value", F.coalesce("Value", F.lit("")))


ORACLE["snk_csv"] = f"""select invoice_id, position, field as "Field", value as "Value" from ({O.ORACLE["csv_long"]})"""


# ---- pages --------------------------------------------------------------------------------------


@query
def st_page_deep(spark: SparkSession, folder: str) -> DataFrame:
    """A page two thirds down the table, and the page that follows its last row."""
    stored = store.to_store(validate_invoices(D.stored_invoices(D.invoices(spark, folder)), AS_OF), F.col("created_at"))
    index = store.index_pages(stored.select("invoice_id", "invoice_number", "created_at"))
    n = index.rows.count()
    page = index.page(limit=100, offset=n * 2 // 3)
    last = page.orderBy("created_at", "invoice_id").first()
    following = store.next_page(index.rows, (last.created_at, last.invoice_id) if last else None)
    both = page.withColumn("page", F.lit(1)).unionByName(following.select(*page.columns).withColumn("page", F.lit(2)))
    return both.select("invoice_id", "invoice_number", "page")


ORACLE["st_page_deep"] = f"""with {O.INV}, r as (select invoice_id, invoice_number, row_number() over (order by d desc, invoice_id desc) - 1 place,
    count(*) over () n from inv)
  select invoice_id, invoice_number, case when place < n*2//3 + 100 then 1 else 2 end page from r
  where place >= n*2//3 and place < n*2//3 + 200"""
