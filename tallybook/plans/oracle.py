"""SQL statements that give the same results as the registered queries, for DuckDB.

Each statement derives its inputs from the order tables by itself (see FIXTURES.md).
"""

from __future__ import annotations

from tallybook.plans import expected as P

AS_OF = "date '2000-06-30'"
NL = "chr(10)"
WS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13), chr(28), chr(29), chr(30), chr(31), chr(133), chr(160))"

# ---- derived inputs -------------------------------------------------------------------------

INV = """
li as (select l_orderkey k, sum(cast(l_extendedprice as decimal(15,2))) st, min(l_suppkey) sk, count(*) ic
  from lineitem group by l_orderkey),
b as (select o_orderkey k, cast(o_orderdate as date) d, o_custkey, li.sk, li.st, li.ic
  from orders left join li on li.k = o_orderkey),
n as (select b.k, b.d, b.ic, b.st,
  case when b.k%31=0 then 'A1' when b.k%29=0 then null
    else concat('INV-', lpad(cast(b.k as string),8,'0')) end invoice_number,
  s_name vendor_name,
  case when b.k%37=0 then null when b.k%41=0 then upper(s_name) else c_name end buyer_name,
  case when b.k%43=0 then 'not a date' when b.k%47=0 then '' else cast(d as string) end invoice_date,
  case when b.k%13=0 then null when b.k%53=0 then cast(d - 10 as string)
    when b.k%59=0 then cast(d + 400 as string) when b.k%61=0 then 'soon' else cast(d + 30 as string) end due_date,
  case when b.k%17=0 then null when b.k%19=0 then 'CHF' else
    case n_regionkey when 0 then 'USD' when 1 then 'EUR' when 2 then 'JPY' when 3 then 'GBP' else 'INR' end
  end currency,
  cast(case when b.k%67=0 then st+5 else st end as decimal(18,2)) sub,
  case when b.k%71=0 then null else cast(round(st*0.08,2) as decimal(18,2)) end tax
  from b join customer on c_custkey=o_custkey join nation on n_nationkey=c_nationkey
  left join supplier on s_suppkey=b.sk),
inv as (select k invoice_id, d, invoice_number, vendor_name, cast(null as varchar) vendor_address, buyer_name,
  cast(null as varchar) buyer_address, invoice_date, due_date, currency, cast(sub as double) subtotal,
  cast(tax as double) tax_amount,
  cast(case when k%73=0 then 0 when k%79=0 then -1*(sub+coalesce(tax,0)) when k%89=0 then (sub+coalesce(tax,0))*1000
    when k%83=0 then (sub+coalesce(tax,0))*50 when k%23=0 then sub+coalesce(tax,0)+1
    else sub+coalesce(tax,0) end as double) total_amount,
  cast(null as varchar) payment_terms, coalesce(ic, 0) item_count, cast(st as double) items_total from n)"""

TXT = (
    INV
    + """,
txt as (select invoice_id, concat(
  coalesce(vendor_name,'Unknown Trading'), chr(10), '12 Harbor Street', chr(10), '12345 Springfield', chr(10),
  case invoice_id%4 when 0 then 'Invoice #: ' when 1 then 'Invoice Number: ' when 2 then 'Rechnungsnummer: '
    else 'Ref #' end, coalesce(invoice_number,''), chr(10),
  case when invoice_id%4=2 then 'Rechnungsdatum: ' else 'Invoice Date: ' end,
  case when invoice_id%4=2 and length(invoice_date)=10 and invoice_date<>'not a date'
    then concat(substr(invoice_date,9,2),'.',substr(invoice_date,6,2),'.',substr(invoice_date,1,4))
    else coalesce(invoice_date,'') end, chr(10),
  case when due_date is null then '' else
    concat(case when invoice_id%4=2 then 'Fälligkeitsdatum: ' else 'Due Date: ' end, due_date, chr(10)) end,
  case when buyer_name is null then '' else concat(case when invoice_id%4=2 then 'Kunde:' else 'Bill To:' end,
    chr(10), buyer_name, chr(10), '1 Road', chr(10), chr(10)) end,
  case when invoice_id%4=1 then
    concat('Total: $', coalesce(cast(cast(total_amount as decimal(18,2)) as string),''), chr(10)) else '' end,
  case when invoice_id%4=2 then 'Zwischensumme: €' else 'Subtotal: $' end,
  coalesce(case when invoice_id%4=3 then cast(cast(floor(subtotal) as bigint) as string)
    else cast(cast(subtotal as decimal(18,2)) as string) end,''), chr(10),
  case when invoice_id%4=2 then 'MwSt: €' else 'Tax: $' end,
  coalesce(cast(cast(tax_amount as decimal(18,2)) as string),''), chr(10),
  case when invoice_id%4=2 then 'Gesamtbetrag: €' when invoice_id%4=1 then 'Amount Due: $' else 'Total: $' end,
  coalesce(cast(cast(total_amount as decimal(18,2)) as string),''), chr(10), 'Net 30', chr(10)) t from inv)"""
)

FILES = """
files as (select o_orderkey file_id,
  case when o_orderkey%6=5 then '' else concat('file-', o_orderkey,
    case o_orderkey%6 when 0 then '.pdf' when 1 then '.PDF' when 2 then '.jpg' when 3 then '.docx' else '.txt' end)
  end file_name,
  cast(case when o_orderkey%50=0 then 0 when o_orderkey%49=0 then 36700160 when o_orderkey%48=0 then 36700161
    else o_orderkey*100+1 end as bigint) as length from orders)"""

GATED = (
    FILES
    + """,
gated as (select *, case when file_name='' then 'No filename provided'
    when not regexp_matches(lower(file_name), '\\.(pdf|jpg|jpeg|png|gif|webp|bmp|docx)$')
      then 'Only PDF, Image (JPG, PNG, GIF, WEBP, BMP), and DOCX files are supported'
    when length > 36700160 then concat('File size (', printf('%.2f', length/1048576.0), 'MB) exceeds 35MB limit')
    when length = 0 then 'File is empty' end error,
  case when file_name='' then 'application/octet-stream' when lower(file_name) like '%.pdf' then 'pdf'
    when lower(file_name) like '%.jpg' then 'image' when lower(file_name) like '%.docx' then 'docx'
    else 'other' end file_type from files)"""
)

STORED = """
stored as (select *, case when invoice_id%10=0 then null when invoice_id%14=0 then invoice_id+100000000000
  else invoice_id end file_id from inv),
wanted as (select distinct c_custkey*17 invoice_id from customer)"""

SECOND = """
snd as (select invoice_id,
  case when invoice_id%12=0 then 'Northwind Traders' when invoice_id%5=0 then upper(vendor_name)
    else vendor_name end r_vendor,
  case when invoice_id%11=0 then null else buyer_name end r_buyer,
  case when invoice_id%7=0 then total_amount*1.10 when invoice_id%9=0 then total_amount*1.04
    else total_amount end r_total,
  case when invoice_id%6=0 then greatest(item_count-1,0) else item_count end r_items from inv),
pair as (select * from inv join snd using (invoice_id))"""

RESPONSES = """
rsp as (select invoice_id, invoice_id%4 shape, invoice_number, vendor_name, buyer_name, invoice_date, due_date, currency,
  cast(cast(subtotal as decimal(18,2)) as varchar) subtotal, cast(cast(tax_amount as decimal(18,2)) as varchar) tax_amount,
  cast(cast(total_amount as decimal(18,2)) as varchar) total_amount from inv)"""

SAMPLES = """
smp as (select o_orderkey invoice_id, o_orderpriority priority, case o_orderkey%8
    when 0 then strftime(o_orderdate,'%m/%d/%Y') when 1 then strftime(o_orderdate,'%d-%m-%Y')
    when 2 then strftime(o_orderdate,'%d.%m.%Y') when 3 then strftime(o_orderdate,'%Y/%m/%d')
    when 4 then strftime(o_orderdate,'%B %-d, %Y') when 5 then strftime(o_orderdate,'%-d %b %Y')
    when 6 then strftime(o_orderdate,'%Y-%m-%d') else concat('  week of ', strftime(o_orderdate,'%Y')) end as date,
  case o_orderkey%8 when 0 then concat('$', a) when 1 then concat('€ 1,', a) when 2 then concat('-', a)
    when 3 then concat(a, ' USD') when 4 then concat('1.2.', a) when 5 then 'n/a' when 6 then ''
    else concat('1,', a) end amount
  from (select *, cast(cast(o_totalprice as decimal(18,2)) as varchar) a from orders))"""

# ---- expressions ----------------------------------------------------------------------------


def strip(c: str) -> str:
    return f"trim({c}, {WS})"


def grab(c: str, pattern: str, group: int = 1, fold: bool = True) -> str:
    return f"nullif(regexp_extract({c}, '{'(?i)' if fold else ''}{pattern}', {group}), '')"


def first(c: str, patterns: list[str], groups: list[int] | None = None) -> str:
    found = [grab(c, p, g) for p, g in zip(patterns, groups or [1] * len(patterns))]
    return f"coalesce({', '.join(found)})"


def first_of(values: list[str], var: str, body: str) -> str:
    """First non-null of ``body`` over the values."""
    return (
        f"list_filter(list_transform([{', '.join(values)}], lambda {var}: {body}), lambda v: v is not null)[1]"
    )


def number(x: str) -> str:
    return f"case when regexp_matches({x}, '^([0-9]+\\.?[0-9]*|\\.[0-9]+)$') then try_cast({x} as double) end"


LEGACY = (
    "case when contains(c, ',') and contains(c, '.') then "
    + number("concat(replace(split_part(c, ',', 1), '.', ''), '.', split_part(c, ',', 2))")
    + " else "
    + number("regexp_replace(c, '[,.]', '', 'g')")
    + " end"
)
NORMALIZED = number("replace(c, ',', '')")


def amount(t: str, patterns: list[str], parse: str) -> str:
    return first_of([grab(t, p) for p in patterns], "c", parse)


def date_after(t: str, labels: list[str]) -> str:
    dates = ", ".join(grab(strip("l"), p, 0) for p in P.DATE_IN_LINE)
    return first_of([grab(t, p) for p in labels], "l", f"coalesce({dates})")


def words_pattern(words: list[str]) -> str:
    return "|".join(words)


def first_line(t: str, stop_words: list[str], longer_than: int, shorter_than: int) -> str:
    return (
        f"list_filter(list_transform(string_split({t}, {NL})[1:10], lambda l: {strip('l')}), "
        f"lambda l: length(l) > {longer_than} and length(l) < {shorter_than} "
        f"and not regexp_matches(lower(l), '{words_pattern(stop_words)}'))[1]"
    )


X_NUMBER = strip(first("t", P.INVOICE_NUMBER))
X_VENDOR = first_line("t", P.VENDOR_STOP_WORDS, 2, 100)
X_BUYER = strip(first("t", P.BUYER_NAME))
X_TOTAL = amount("t", P.TOTAL_AMOUNT, LEGACY)
X_SUBTOTAL = amount("t", P.SUBTOTAL, LEGACY)
X_TAX = amount("t", P.TAX_AMOUNT, LEGACY)
X_CURRENCY = (
    "case "
    + " ".join(f"when contains(t, '{mark}') then '{code}'" for mark, code in P.CURRENCY_MARKS)
    + " else 'EUR' end"
)
EXTRACTED = f"""
ext as (select invoice_id, {X_NUMBER} invoice_number, {X_VENDOR} vendor_name, {X_BUYER} buyer_name,
  {date_after('t', P.INVOICE_DATE_LINE)} invoice_date, {date_after('t', P.DUE_DATE_LINE)} due_date,
  {X_CURRENCY} currency, {X_TOTAL} total_amount, {X_SUBTOTAL} subtotal, {X_TAX} tax_amount,
  cast(null as double) items_total from txt)"""


def layout_iso(line: str) -> str:
    parts = []
    for pattern, (y, m, d) in P.LAYOUT_DATES:
        month = f"regexp_extract({line}, '(?i){pattern}', {m})"
        day = f"regexp_extract({line}, '(?i){pattern}', {d})"
        if "Jan" in pattern:
            names = ", ".join(f"'{x}'" for x in P.MONTHS)
            month = f"lpad(cast(list_position([{names}], lower({month}[1:3])) as varchar), 2, '0')"
        year = f"regexp_extract({line}, '(?i){pattern}', {y})"
        iso = f"concat({year}, '-', {month}, '-', lpad({day}, 2, '0'))"
        parts.append(f"when regexp_matches({line}, '(?i){pattern}') then {iso}")
    return "case " + " ".join(parts) + " end"


# ---- the rule set ------------------------------------------------------------------------------


def parsed_date(c: str) -> str:
    """ISO days and dotted or dashed days, month-first unless the first number cannot be a month."""
    return (
        f"case when regexp_matches({c}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') then try_cast({c} as date) "
        f"when regexp_matches({c}, '^[0-9]{{2}}[.][0-9]{{2}}[.][0-9]{{4}}$') then "
        f"case when cast({c}[1:2] as int) > 12 then cast(try_strptime({c}, '%d.%m.%Y') as date) "
        f"else cast(try_strptime({c}, '%m.%d.%Y') as date) end end"
    )


def rules(src: str, documented: bool = False) -> str:
    """CTE ``val``: the rows of ``src`` with their list of hits."""
    suspicious = "total_amount > 10000000" if documented else "false"
    checks = [
        ("V01", "error", 15, "coalesce(invoice_number,'')=''", "'Missing required field: Invoice Number'"),
        ("V02", "error", 15, "coalesce(vendor_name,'')=''", "'Missing required field: Vendor Name'"),
        ("V03", "error", 15, "coalesce(total_amount,0)=0", "'Missing required field: Total Amount'"),
        ("V04", "error", 15, "coalesce(invoice_date,'')=''", "'Missing required field: Invoice Date'"),
        ("V05", "warning", 5, "coalesce(buyer_name,'')=''", "'Missing important field: Buyer Name'"),
        ("V06", "warning", 5, "coalesce(currency,'')=''", "'Missing important field: Currency'"),
        ("V07", "warning", 5, "coalesce(due_date,'')=''", "'Missing important field: Due Date'"),
        (
            "V08",
            "error",
            10,
            "length(invoice_number) between 1 and 2",
            "'Invoice number is too short (minimum 3 characters)'",
        ),
        (
            "V09",
            "error",
            10,
            "coalesce(invoice_date,'')<>'' and i is null",
            "concat('Invalid invoice date format: ', invoice_date)",
        ),
        (
            "V10",
            "error",
            10,
            "coalesce(due_date,'')<>'' and u is null",
            "concat('Invalid due date format: ', due_date)",
        ),
        ("V11", "error", 15, "total_amount < 0", "'Total amount cannot be negative'"),
        ("V12", "warning", 5, "total_amount = 0", "'Total amount is zero'"),
        (
            "V13",
            "warning",
            3,
            "coalesce(currency,'')<>'' and currency not in ('USD','EUR','GBP','INR','CAD','AUD','JPY')",
            "concat('Uncommon currency code: ', currency)",
        ),
        ("V14", "error", 15, "u < i", "'Due date cannot be before invoice date'"),
        (
            "V15",
            "warning",
            5,
            "date_diff('day', i, u) > 365",
            "concat('Unusually long payment term: ', date_diff('day', i, u), ' days')",
        ),
        (
            "V16",
            "error",
            20,
            "subtotal<>0 and tax_amount<>0 and total_amount<>0 and abs(subtotal+tax_amount-total_amount) > 0.01::double",
            "concat('Amount mismatch: Subtotal (', subtotal::varchar, ') + Tax (', tax_amount::varchar, "
            "') does not equal Total (', total_amount::varchar, ')')",
        ),
        (
            "V17",
            "warning",
            5,
            "subtotal<>0 and items_total>0 and abs(items_total-subtotal) > 0.01::double",
            "concat('Line items total (', items_total::varchar, ') does not match subtotal (', subtotal::varchar, ')')",
        ),
        (
            "V18",
            "warning",
            3,
            f"total_amount > 1000000 and not {suspicious}",
            "concat('Unusually high amount: ', total_amount::varchar)",
        ),
        ("V19", "error", 10, suspicious, "concat('Suspiciously high amount: ', total_amount::varchar)"),
        (
            "V20",
            "warning",
            5,
            "vendor_name<>'' and buyer_name<>'' and lower(vendor_name)=lower(buyer_name)",
            "'Vendor and buyer names are identical'",
        ),
        (
            "V21",
            "warning",
            5,
            f"date_diff('day', i, {AS_OF}) < -30",
            f"concat('Invoice date is ', abs(date_diff('day', i, {AS_OF})), ' days in the future')",
        ),
        (
            "V22",
            "warning",
            3,
            f"date_diff('day', i, {AS_OF}) > 730",
            f"concat('Invoice is ', date_diff('day', i, {AS_OF}), ' days old')",
        ),
    ]
    hits = ",\n    ".join(
        f"case when {cond} then {{'rule': '{r}', 'severity': '{s}', 'penalty': {p}, 'message': {m}}} end"
        for r, s, p, cond, m in checks
    )
    return f"""
val as (select *, cast(greatest(0, 100 - coalesce(list_sum(list_transform(hits, lambda h: h.penalty)), 0)) as integer) score,
  list_transform(list_filter(hits, lambda h: h.severity='error'), lambda h: h.message) errors,
  list_transform(list_filter(hits, lambda h: h.severity='warning'), lambda h: h.message) warnings,
  len(list_filter(hits, lambda h: h.severity='error'))=0 is_valid
  from (select *, list_filter([{hits}], lambda h: h is not null) hits
    from (select *, {parsed_date('invoice_date')} i, {parsed_date('due_date')} u from {src})))"""


VAL = INV + "," + rules("inv")

HITS = "select invoice_id, unnest(hits, recursive := true) from val"


def money(c: str) -> str:
    return f"cast(cast({c} as decimal(18,2)) as varchar)"


# ---- statements --------------------------------------------------------------------------------

ORACLE: dict[str, str] = {}

# Validation
ORACLE["v_result"] = f"""with {VAL} select invoice_id, invoice_number, is_valid, score,
  cast(len(errors) as integer) n_errors, cast(len(warnings) as integer) n_warnings from val"""
ORACLE["v_messages"] = f"""with {VAL} select invoice_id, array_to_string(errors, ' | ') errors,
  array_to_string(warnings, ' | ') warnings from val"""
ORACLE["v_rule_hits"] = f"with {VAL} {HITS}"
ORACLE["v_high_amount"] = f"""with {INV}, {rules('inv', True)}
  select invoice_id, rule, severity, penalty from ({HITS}) where rule in ('V18','V19')"""
ORACLE["v_bands"] = f"""with {VAL} select case when score>=80 then 'high' when score>=60 then 'medium' else 'low' end band,
  count(*) n from val group by 1"""

# Summaries
ORACLE["ag_dashboard"] = f"""with {VAL} select count(*) total_invoices, count(*) filter (is_valid) valid_invoices,
  count(*) filter (not is_valid) invalid_invoices,
  cast(round(sum(cast(coalesce(total_amount,0) as decimal(28,10))), 2) as double) total_amount, 0::bigint unsummed_amounts,
  cast(round(sum(score)::decimal(18,0)/count(*), 2) as double) average_validation_score from val"""
ORACLE["ag_summary"] = f"""with {VAL} select count(*) total_invoices, count(*) filter (is_valid) valid_invoices,
  count(*) filter (not is_valid) invalid_invoices from val"""
ORACLE["ag_error_counts"] = f"""with {VAL} select error, count(*) n from (select unnest(errors) error from val) group by 1"""

RECORDS = (
    INV
    + """,
rec as (select * from (select invoice_id, unnest(case when invoice_id%7=0 and invoice_id%11<>0 and invoice_id%13<>0
    and invoice_id%17<>0 then [1,2] else [1] end) copy,
  case when invoice_id%11=0 then 'invoice_number: Input should be a valid string'
    when invoice_id%13=0 then 'Malformed JSON'
    when invoice_id%17=0 then 'subtotal: Input should be a valid number' end load_error,
  invoice_number, vendor_name, cast(null as varchar) buyer_name, invoice_date, due_date, cast(null as varchar) currency,
  total_amount, cast(null as double) subtotal, cast(null as double) tax_amount, cast(null as double) items_total from inv))"""
)
ORACLE["ag_load_summary"] = f"""with {RECORDS}, {rules('rec')}
  select count(*) filter (is_valid and load_error is null) valid, count(*) total,
  count(*) filter (load_error is not null) unreadable from val"""
ORACLE["src_json"] = f"""with {RECORDS} select invoice_id, load_error,
  case when load_error is null then invoice_number end invoice_number,
  case when load_error is null then vendor_name end vendor_name,
  case when load_error is null then due_date end due_date,
  case when load_error is null then {money('total_amount')} end total_amount from rec"""
ORACLE["ag_verify_stats"] = f"""with {INV}, v as (select coalesce(invoice_number,'')<>'' and coalesce(vendor_name,'')<>''
    and coalesce(total_amount,0)<>0 ok from inv)
  select count(*) total_invoices, count(*) filter (ok) verified, count(*) filter (not ok) review_needed,
  0::bigint high_confidence, 0::bigint low_confidence, 0::bigint total_corrections, avg(case when ok then 95.0::double else 50.0 end) average_confidence from v"""
ORACLE["ag_batch"] = f"""with {GATED} select count(*) total_files, count(*) filter (error is null) successful,
  count(*) filter (error is not null) failed,
  cast(round(count(*) filter (error is null)::decimal(18,0)*100/count(*), 1) as double) success_rate from gated"""
ORACLE["ag_batch_errors"] = f"with {GATED} select file_name, error from gated where error is not null"
COMPLETE = """(case when invoice_number<>'' then 1 else 0 end + case when vendor_name<>'' then 1 else 0 end
  + case when buyer_name<>'' then 1 else 0 end + case when invoice_date<>'' then 1 else 0 end
  + case when due_date<>'' then 1 else 0 end + case when currency<>'' then 1 else 0 end
  + case when total_amount is not null then 1 else 0 end + case when item_count is not null then 1 else 0 end)"""
ORACLE["ag_completeness"] = f"""with {INV} select invoice_id, cast(c as integer) extracted_fields,
  case when c>=6 then 85.0::double else 60.0::double end source_confidence, c>=8 is_complete from (select *, {COMPLETE} c from inv)"""

# Verification
CRITICAL = """list_filter([case when coalesce(invoice_number,'')='' then 'Missing invoice number' end,
  case when coalesce(vendor_name,'')='' then 'Missing vendor name' end,
  case when coalesce(total_amount,0)=0 then 'Missing total amount' end], lambda x: x is not null)"""
ORACLE["g_verify"] = f"""with {INV}, c as (select *, {CRITICAL} crit from inv)
  select invoice_id, coalesce(nullif(invoice_number,''),'N/A') verified_number,
  case when len(crit)>0 then 'Review Needed' else 'Verified' end status,
  case when len(crit)>0 then 50.0::double else 95.0::double end overall_confidence,
  concat('Verification complete. Status: ', case when len(crit)>0 then 'Review Needed' else 'Verified' end) summary,
  array_to_string(crit, ' | ') critical_issues from c"""
ORACLE["g_verify_fields"] = f"""with {INV}, f as (
  select invoice_id, 'vendor_name' field_name, vendor_name v, 80.0::double confidence from inv
  union all select invoice_id, 'subtotal', subtotal::varchar, 90.0 from inv
  union all select invoice_id, 'tax_amount', tax_amount::varchar, 90.0 from inv
  union all select invoice_id, 'total_amount', total_amount::varchar, 90.0 from inv
  union all select invoice_id, 'invoice_date', invoice_date, 85.0 from inv
  union all select invoice_id, 'due_date', due_date, 85.0 from inv)
  select invoice_id, field_name, v original_value, v corrected_value, confidence, 'stub' source, false requires_review from f"""
ORACLE["g_recommend"] = f"""with {VAL}, c as (select *, {CRITICAL} crit from val)
  select invoice_id, score, case when len(crit)>0 then 'Review Needed' else 'Verified' end status,
  len(errors)>0 or len(crit)>0 requires_review, len(errors)=0 and len(crit)=0 approval_ready,
  case when len(errors)=0 and len(crit)=0 then 'Very High' when len(crit)=0 then 'High' else 'Low' end confidence_level,
  array_to_string(errors, ' | ') required_actions from c"""

# Store and views
STORE = VAL + "," + STORED.replace("from inv)", "from val)", 1)
ORACLE["st_store"] = f"""with {STORE} select invoice_id, invoice_number, coalesce(nullif(currency,''),'USD') currency, is_valid,
  score validation_score, cast(len(errors) as integer) n_errors, cast(len(warnings) as integer) n_warnings, file_id,
  strftime(d, '%Y-%m-%d') created_on from stored"""
ORACLE["st_get"] = f"with {VAL} select invoice_id, invoice_number, score validation_score from val where invoice_id=1234"
ORACLE["st_page"] = f"with {INV} select invoice_id, invoice_number from inv order by d desc, invoice_id desc limit 100 offset 40"
ORACLE["st_page_envelope"] = f'with {INV} select count(*) total, 100 "limit", 40 "offset" from inv'
ORACLE["st_delete"] = f"""with {INV}, {STORED} select invoice_id, invoice_number from stored
  where invoice_id not in (select invoice_id from wanted)"""
ORACLE["st_delete_files"] = f"""with {INV}, {STORED}, {FILES} select file_id, length from files where file_id not in
  (select file_id from stored where file_id is not null and invoice_id in (select invoice_id from wanted))"""
ORACLE["st_delete_outcome"] = f"""with {INV}, {STORED} select w.invoice_id, s.invoice_id is not null deleted
  from wanted w left join stored s on s.invoice_id = w.invoice_id"""
ORACLE["st_file_lookup"] = f"""with {INV}, {STORED}, {FILES} select w.invoice_id, f.file_name,
  case when s.invoice_id is null then 'Invoice not found' when s.file_id is null then 'No file associated with this invoice'
    when f.file_id is null then 'File not found' else 'ok' end status
  from wanted w left join stored s on s.invoice_id=w.invoice_id left join files f on f.file_id=s.file_id"""
ORACLE["st_list_view"] = f"""with {VAL} select invoice_id, coalesce(nullif(invoice_number,''),'-') invoice_number,
  coalesce(nullif(vendor_name,''),'-') vendor_name, coalesce(nullif(buyer_name,''),'-') buyer_name,
  coalesce(nullif(invoice_date,''),'-') invoice_date,
  concat(coalesce(nullif(currency,''),'USD'), ' ', coalesce(cast(cast(total_amount as decimal(18,2)) as varchar),'0.00')) amount,
  case when is_valid then 'Valid' else 'Invalid' end status, score from val"""
ORACLE["st_result_view"] = f"""with {VAL} select invoice_id, is_valid, score, array_to_string(errors, ' | ') errors,
  vendor_name, total_amount from val"""


def _csv_value(c: str) -> str:
    return f"case when coalesce({c},0)=0 then '' else regexp_replace({c}::varchar, '\\.0$', '') end"


ORACLE["csv_long"] = f"""with {INV} select invoice_id, unnest([
  {{'position':1,'field':'Invoice Number','value':coalesce(invoice_number,'')}},
  {{'position':2,'field':'Vendor Name','value':coalesce(vendor_name,'')}},
  {{'position':3,'field':'Buyer Name','value':coalesce(buyer_name,'')}},
  {{'position':4,'field':'Invoice Date','value':coalesce(invoice_date,'')}},
  {{'position':5,'field':'Due Date','value':coalesce(due_date,'')}},
  {{'position':6,'field':'Currency','value':coalesce(currency,'')}},
  {{'position':7,'field':'Subtotal','value':{_csv_value('subtotal')}}},
  {{'position':8,'field':'Tax Amount','value':{_csv_value('tax_amount')}}},
  {{'position':9,'field':'Total Amount','value':{_csv_value('total_amount')}}},
  {{'position':10,'field':'Payment Terms','value':coalesce(payment_terms,'')}}], recursive := true) from inv"""

# Files and text
ORACLE["src_gate"] = f"with {GATED} select file_id, error from gated"
ORACLE["src_gate_pdf"] = f"""with {GATED}, p as (select *, file_name='' nameless, lower(file_name) like '%.pdf' pdf,
    length>36700160 large, length=0 hollow from gated)
  select file_id, case when nameless then 'No filename provided' when error like 'Only%' then error
    when large then 'File size exceeds 35MB limit' when hollow then 'File is empty' end single_error,
  case when nameless then 'No filename provided' when not pdf then 'Only PDF files are supported for dual-source extraction'
    when large then 'File size exceeds 35MB limit' when hollow then 'File is empty' end merge_error,
  case when nameless then 'No filename provided' when not pdf then 'Only PDF files supported'
    when large then 'File exceeds 35MB' when hollow then 'File is empty' end document_error,
  case when nameless then 'No filename provided' when not pdf then 'Only PDF files are supported'
    when large then 'File size exceeds 35MB limit' when hollow then 'File is empty' end layout_error from p"""
ORACLE["src_type"] = f"""with {GATED} select file_id, file_type, case file_type when 'pdf' then 'application/pdf'
  when 'image' then 'image/jpeg' when 'docx' then 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
  else 'application/octet-stream' end content_type from gated"""
ORACLE["src_unsupported"] = f"""with {GATED} select file_id, false is_valid, 0 score,
  'File type not supported for extraction' errors from gated where error is null and file_type<>'pdf'"""
CUT = "case when instr(t,'Bill To')>0 then instr(t,'Bill To') when instr(t,'Kunde')>0 then instr(t,'Kunde') else length(t)+1 end"
PAGES = f"""
pg as (select invoice_id, 0 page, substr(t, 1, cut-1) txt from (select *, {CUT} cut from txt)
  union all select invoice_id, 1, substr(t, cut) from (select *, {CUT} cut from txt))"""
ORACLE["src_text"] = f"with {TXT} select invoice_id, t as text from txt"
ORACLE["src_text_layout"] = f"""with {TXT}, {PAGES} select invoice_id,
  string_agg(concat(txt, chr(10)), '' order by page) as text from pg group by 1"""
ORACLE["src_needs_ocr"] = f"with {TXT}, {PAGES} select invoice_id, page, length({strip('txt')})<50 needs_ocr from pg"
ORACLE["src_documents_ocr"] = f"select doc_id, length({strip('text')})<50 needs_ocr from documents"

# Normalisers
ORACLE["n_text"] = f"select doc_id, nullif(regexp_replace({strip('text')}, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}]+', ' ', 'g'), '') as text from documents"
ORACLE["n_date"] = f"""with {SAMPLES} select invoice_id, case when regexp_matches(trim(date), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')
  then trim(date) else coalesce(strftime(try_strptime(trim(date), ['%m/%d/%Y','%d/%m/%Y','%d-%m-%Y','%d.%m.%Y','%Y/%m/%d',
  '%Y-%m-%d','%B %d, %Y','%B %d %Y','%d %B %Y','%d-%b-%Y','%d/%b/%Y','%d %b %Y','%b %d, %Y']), '%Y-%m-%d'), trim(date)) end as date from smp"""
ORACLE["n_amount"] = f"""with {SAMPLES} select invoice_id, case when regexp_matches(k, '^-?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') then k end amount
  from (select *, regexp_replace(amount, '[^0-9.\\-]', '', 'g') k from smp)"""
ORACLE["n_gst"] = f"""with {SAMPLES} select invoice_id, g gst, length(g)=15 gst_ok from
  (select *, regexp_replace(upper(concat('29ab-', priority, ' ', invoice_id)), '[^A-Z0-9]', '', 'g') g from smp)"""
ORACLE["n_layout_date"] = f"with {SAMPLES} select invoice_id, {layout_iso('date')} as date from smp"
CAPTURED = "(select *, nullif(regexp_extract(amount, '([0-9,]+\\.?[0-9]*)', 1), '') c from smp)"
ORACLE["n_amount_basic"] = f"with {SAMPLES} select invoice_id, {LEGACY} amount from {CAPTURED}"
ORACLE["n_amount_norm"] = f"with {SAMPLES} select invoice_id, {NORMALIZED} amount from {CAPTURED}"
ORACLE["n_currency"] = f"""with {TXT} select invoice_id, {X_CURRENCY} basic, case when contains(t,'$') or contains(t,'USD') then 'USD'
  when contains(t,'€') or contains(t,'EUR') then 'EUR' end layout from txt"""
ORACLE["n_model_invoice"] = f"""with {INV}, {RESPONSES} select invoice_id, shape<>3 parsed,
  case when shape<>3 then nullif(invoice_number,'') end invoice_number, case when shape<>3 then nullif(vendor_name,'') end vendor_name,
  case when shape<>3 then nullif(currency,'') end currency, case when shape<>3 then nullif(due_date,'') end due_date,
  case when shape<>3 then total_amount end total_amount from rsp"""

# Basic extraction
ORACLE["x_number"] = f"with {TXT} select invoice_id, {X_NUMBER} invoice_number from txt"
ORACLE["x_vendor"] = f"with {TXT} select invoice_id, {X_VENDOR} vendor_name from txt"
ORACLE["x_vendor_documents"] = f"select doc_id, {first_line('text', P.VENDOR_STOP_WORDS, 2, 100)} vendor_name from documents"
ORACLE["x_buyer"] = f"with {TXT} select invoice_id, {X_BUYER} buyer_name from txt"
STREET = f"regexp_matches(l, '(?i)\\d+.*(?:{words_pattern(P.STREET_WORDS)})')"
ZIP = f"regexp_matches(l, '{P.ZIP_LINE}')"
ORACLE["x_vendor_addr"] = f"""with {TXT}, ln as (select invoice_id, string_split(t, {NL})[1:15] ls from txt),
  z as (select *, coalesce(list_position(list_transform(ls, lambda l: {ZIP} and not {STREET}), true), 0) zip_at from ln),
  kept as (select invoice_id, list_filter(case when zip_at>0 then ls[1:zip_at] else ls end, lambda l: {ZIP} or {STREET}) ls from z)
  select invoice_id, case when len(ls)>0 then array_to_string(list_transform(ls, lambda l: {strip('l')}), ' ') end vendor_address from kept"""
ORACLE["x_buyer_addr"] = f"with {TXT} select invoice_id, {strip(first('t', P.BUYER_ADDRESS))} buyer_address from txt"
ORACLE["x_dates"] = f"""with {TXT} select invoice_id, {date_after('t', P.INVOICE_DATE_LINE)} invoice_date,
  {date_after('t', P.DUE_DATE_LINE)} due_date from txt"""
ORACLE["x_amounts"] = f"with {TXT} select invoice_id, {X_TOTAL} total_amount, {X_SUBTOTAL} subtotal, {X_TAX} tax_amount from txt"
NOT_SUB = "regexp_replace(t, '(?i)subtotal', 'sub-', 'g')"
ORACLE["x_amounts_normalized"] = f"""with {TXT} select invoice_id, {amount(NOT_SUB, P.TOTAL_AMOUNT, NORMALIZED)} total_amount,
  {amount('t', P.SUBTOTAL, NORMALIZED)} subtotal, {amount('t', P.TAX_AMOUNT, NORMALIZED)} tax_amount from txt"""
ORACLE["x_terms"] = f"""with {TXT} select invoice_id,
  {strip(first('t', [p for p, _ in P.PAYMENT_TERMS], [g for _, g in P.PAYMENT_TERMS]))} payment_terms from txt"""
SHEETS = """
sh as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, concat('Delivery 10 20', chr(10),
  case when l_linenumber%2=0 then 'Artikel Menge Preis Summe' else 'Description Qty Price Total' end, chr(10),
  p_name, ' ', q, ' ', cast(cast(p_retailprice as decimal(18,2)) as varchar), ' ', e, chr(10),
  upper(p_name[1:1]), split_part(p_name,' ',1)[2:], ' ', upper(split_part(p_name,' ',2)[1:1]), split_part(p_name,' ',2)[2:],
  ' (spare) ', q, ' ', e, chr(10), 'note for ', p_name, ' ', q, chr(10), '7x ', p_name, ' ', q, ' ', e, chr(10),
  case when l_linenumber%2=0 then 'Zwischensumme ' else 'Subtotal ' end, e, chr(10), p_name, ' 1 2 3', chr(10)) t
  from (select *, cast(cast(l_quantity as int) as varchar) q, cast(cast(l_extendedprice as decimal(18,2)) as varchar) e
    from lineitem) join part on p_partkey=l_partkey)"""
HDR = f"(regexp_matches(l, '(?i){words_pattern(P.ITEM_HEADER_NAMES)}') and regexp_matches(l, '(?i){words_pattern(P.ITEM_HEADER_VALUES)}'))"
ORACLE["x_items"] = f"""with {SHEETS},
  a as (select *, string_split(t, {NL}) ls from sh),
  h as (select *, list_position(list_transform(ls, lambda l: {HDR}), true) hat from a),
  bd as (select *, list_filter(ls[hat+1:], lambda l: not {HDR}) body from h where hat > 0),
  st as (select *, coalesce(list_position(list_transform(body, lambda l: regexp_matches(l, '(?i){words_pattern(P.ITEM_SECTION_ENDS)}')), true), 0) sat from bd),
  l as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest(case when sat>0 then body[1:sat-1] else body end) l from st),
  nm as (select *, list_transform(regexp_extract_all(l, '{P.ITEM_NUMBER}', 1), lambda x: try_cast(regexp_replace(x, '[,.]', '', 'g') as double)) ns,
    regexp_extract(l, '{P.ITEM_DESCRIPTION}', 1) dsc from l)
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, {strip('dsc')} description, ns[1] quantity,
  case when len(ns)>=3 then ns[2] end price, case when len(ns)>=3 then ns[3] else ns[2] end total
  from nm where dsc<>'' and len(ns)>=2 and len(list_filter(ns, lambda x: x is null))=0"""
ORACLE["x_invoice"] = f"""with {TXT}, {EXTRACTED}, {rules('ext')} select invoice_id, invoice_number, vendor_name, buyer_name,
  total_amount, is_valid, score from val"""

# Layout extraction
ORACLE["lx_vendor_words"] = f"""with {TXT}, w as (select invoice_id, line, unnest(string_split(lt, ' ')) word,
    generate_subscripts(string_split(lt, ' '), 1) pos
    from (select invoice_id, unnest(string_split(t, {NL})) lt, generate_subscripts(string_split(t, {NL}), 1) - 1 line from txt)),
  r as (select *, row_number() over (partition by invoice_id order by line, pos) rn from w where word<>'' and line*14.0 < 150)
  select invoice_id, arg_min({strip('word')}, rn) vendor_word from r where rn<=10 and length({strip('word')})>3
  and not regexp_matches(lower(word), '{words_pattern(P.LAYOUT_VENDOR_STOP_WORDS)}') group by 1"""
_labelled = first("t", [label.replace(" ", "\\ ") + r"\s*:?\s*\n\s*([^\n]+)" for label in P.LAYOUT_BUYER_LABELS])
_marked = ", ".join(
    f"case when contains(t, '{m}') then {grab(f'substr(t, instr(t, {chr(39)}{m}{chr(39)}))', chr(92) + 'n' + chr(92) + 's*([^' + chr(92) + 'n]+)')} end"
    for m in P.LAYOUT_BUYER_MARKS
)
LX_BUYER = strip(f"coalesce({_labelled}, {_marked})")
LX_FALLBACK_BUYER = strip(f"regexp_extract(t, '(?i)([^\\n]*?){P.FALLBACK_STREET}', 1)")
ORACLE["lx_buyer"] = f"""with {TXT} select invoice_id, {LX_BUYER} buyer_name,
  case when length({LX_FALLBACK_BUYER})>3 then {LX_FALLBACK_BUYER} end fallback from txt"""
LX_NUMBER = first_of(
    [grab("t", p) for p in P.LAYOUT_INVOICE_NUMBER], "c", f"case when length(c)>=3 then {strip('c')} end"
)
ORACLE["lx_number"] = f"with {TXT} select invoice_id, {LX_NUMBER} invoice_number from txt"
LX_LINES = f"""
lxl as (select *, {strip(first('t', P.LAYOUT_INVOICE_DATE_LINE))} i_line, {strip(first('t', P.LAYOUT_DUE_DATE_LINE))} d_line from txt)"""
ORACLE["lx_dates"] = f"""with {TXT}, {LX_LINES} select invoice_id, {layout_iso('i_line')} invoice_date,
  {layout_iso('d_line')} due_date from lxl"""
LX_AMOUNTS = f"""
lxa as (select invoice_id, t, {amount('t', P.LAYOUT_TOTAL, NORMALIZED)} total, {amount('t', P.LAYOUT_SUBTOTAL, NORMALIZED)} sub,
  {amount('t', P.LAYOUT_TAX, NORMALIZED)} tax from txt)"""
ORACLE["lx_amounts"] = f"with {TXT}, {LX_AMOUNTS} select invoice_id, total total_amount, sub subtotal, tax tax_amount from lxa"
ORACLE["lx_fallback_vendor"] = f"with {TXT} select invoice_id, {first_line('t', P.FALLBACK_VENDOR_STOP_WORDS, 3, 1000000000)} vendor_name from txt"
COMPUTED = """
c1 as (select *, case when coalesce(tax0,0)=0 and total0<>0 and sub0<>0 and abs(total0-sub0) < total0*0.5 then total0-sub0 else tax0 end tax1,
  case when coalesce(tax0,0)=0 and total0<>0 and sub0<>0 and abs(total0-sub0) < total0*0.5 then 'computed' else tax_src end tax_src1 from c0),
c2 as (select *, case when coalesce(sub0,0)=0 and total0<>0 and tax1<>0 and total0-tax1>0 then total0-tax1 else sub0 end sub1,
  case when coalesce(sub0,0)=0 and total0<>0 and tax1<>0 and total0-tax1>0 then 'computed' else sub_src end sub_src1 from c1)"""
ORACLE["lx_compute"] = f"""with {TXT}, {LX_AMOUNTS},
  c0 as (select invoice_id, nullif(total,0) total0, nullif(sub,0) sub0, nullif(tax,0) tax0,
    case when nullif(tax,0) is not null then 'layout' end tax_src, case when nullif(sub,0) is not null then 'layout' end sub_src from lxa),
  {COMPUTED}
  select invoice_id, {money('sub1')} subtotal, {money('tax1')} tax_amount, sub_src1 subtotal_source, tax_src1 tax_amount_source from c2"""
ORACLE["lx_invoice"] = f"""with {TXT}, {LX_AMOUNTS}, {RESPONSES},
  vw as ({ORACLE['lx_vendor_words'].split('with ' + TXT + ', w as ', 1)[1] and 'select * from vwords'}),
  j as (select a.*, m.shape in (0,1) has_model, m.invoice_number m_number, m.vendor_name m_vendor, m.buyer_name m_buyer, m.currency m_currency,
    try_cast(m.total_amount as double) m_total, try_cast(m.subtotal as double) m_sub, try_cast(m.tax_amount as double) m_tax,
    vw.vendor_word, {LX_NUMBER} l_number, {grab('t', P.PLAIN_NUMBER, 1, False)} p_number, {LX_BUYER} l_buyer,
    case when contains(t,'$') or contains(t,'USD') then 'USD' when contains(t,'€') or contains(t,'EUR') then 'EUR' end p_currency,
    {first_line('t', P.FALLBACK_VENDOR_STOP_WORDS, 3, 1000000000)} f_vendor, {LX_FALLBACK_BUYER} f_buyer
    from lxa a join rsp m using (invoice_id) left join vw using (invoice_id)),
  p as (select *, case when has_model and m_number is not null then m_number else coalesce(nullif(l_number,''), p_number) end number0,
    case when has_model and m_number is not null then 95.0 when nullif(l_number,'') is not null then 90.0 when p_number is not null then 60.0 end number_c,
    case when has_model and m_vendor is not null then m_vendor else vendor_word end vendor0,
    case when has_model and m_vendor is not null then 95.0 when vendor_word is not null then 85.0 end vendor_c0,
    case when has_model and m_buyer is not null then m_buyer else nullif(l_buyer,'') end buyer0,
    case when has_model and m_currency is not null then m_currency else p_currency end currency0,
    case when has_model and m_total is not null then m_total else nullif(total,0) end total0,
    case when has_model and m_sub is not null then m_sub else nullif(sub,0) end sub0,
    case when has_model and m_tax is not null then m_tax else nullif(tax,0) end tax0,
    case when has_model and m_tax is not null then 'model' when nullif(tax,0) is not null then 'layout' end tax_src,
    case when has_model and m_sub is not null then 'model' when nullif(sub,0) is not null then 'layout' end sub_src from j),
  c0 as (select *, case when coalesce(vendor0,'')='' and f_vendor is not null then f_vendor else vendor0 end vendor1,
    case when coalesce(vendor0,'')='' and f_vendor is not null then 50.0 else vendor_c0 end vendor_c,
    case when coalesce(buyer0,'')='' and length(f_buyer)>3 then f_buyer else buyer0 end buyer1 from p),
  {COMPUTED}
  select invoice_id, number0 invoice_number, vendor1 vendor_name, buyer1 buyer_name, currency0 currency, {money('sub1')} subtotal,
  {money('tax1')} tax_amount, {money('total0')} total_amount, number_c::double invoice_number_confidence, vendor_c::double vendor_name_confidence,
  case tax_src1 when 'model' then 95.0 when 'layout' then 85.0 when 'computed' then 80.0 end::double tax_amount_confidence,
  tax_src1 tax_amount_source from c2"""
# The words query, as a named table ahead of its use above.
_words_body = ORACLE["lx_vendor_words"][len(f"with {TXT}, ") :]
_w_ctes, _w_select = _words_body.split("\n  select invoice_id, arg_min", 1)
ORACLE["lx_invoice"] = ORACLE["lx_invoice"].replace(
    f"with {TXT}, ", f"with {TXT}, {_w_ctes}, vwords as (select invoice_id, arg_min{_w_select}), ", 1
)
ORACLE["lx_merge"] = f"""with {INV}, e as (
  select invoice_id, 'invoice_number' field, concat('R', invoice_id) v, 60.0 confidence, 'regex' source from inv
  union all select invoice_id, 'invoice_number', concat('L', invoice_id), case when invoice_id%5=0 then 60 else 90 end, 'layout' from inv
  union all select invoice_id, 'invoice_number', invoice_number, 95, 'model' from inv
  union all select invoice_id, 'currency', 'USD', 70, 'regex' from inv
  union all select invoice_id, 'currency', currency, 95, 'model' from inv
  union all select invoice_id, 'buyer_name', buyer_name, 80, 'layout' from inv),
  r as (select *, row_number() over (partition by invoice_id, field order by (source='model') desc, confidence desc, (source='regex') desc) rn
    from e where source<>'model' or v is not null)
  select invoice_id, field, v as value, confidence::double confidence, source from r where rn=1"""

# Responses and entities
ORACLE["l_fences"] = f"""with {INV}, {RESPONSES} select invoice_id, shape in (0,1) parsed,
  case when shape in (0,1) then invoice_number end invoice_number, case when shape in (0,1) then vendor_name end vendor_name,
  case when shape in (0,1) then total_amount end total_amount from rsp"""
ORACLE["l_fences_anywhere"] = f"""with {INV}, {RESPONSES} select invoice_id, shape in (0,1) parsed,
  case when shape in (0,1) then invoice_number end invoice_number, case when shape in (0,1) then buyer_name end buyer_name,
  case when shape in (0,1) then invoice_date end invoice_date from rsp"""
_json_fields = [
    "invoice_number",
    "vendor_name",
    "buyer_name",
    "invoice_date",
    "due_date",
    "currency",
    "subtotal",
    "tax_amount",
    "total_amount",
]
_json_parts = ", ".join(f"""case when {f} is not null then concat('"{f}":"', {f}, '"') end""" for f in _json_fields)
ORACLE["l_braces"] = f"""with {INV}, {RESPONSES}, j as (select invoice_id, shape,
  concat('{{', array_to_string(list_filter([{_json_parts}], lambda x: x is not null), ','), '}}') body from rsp)
  select invoice_id, case when shape=3 then concat('{{', body) else body end as json from j"""
ORACLE["l_gst_invoice"] = f"""with {INV} select invoice_id, true parsed,
  case when vendor_name is not null then concat(vendor_name, ' Ltd') end supplier_name,
  concat('29ABCDE', lpad(cast(invoice_id%10000 as varchar),4,'0'), 'F1Z5') supplier_gst, true supplier_gst_ok,
  nullif(buyer_name,'') customer_name, invoice_number,
  case when invoice_id%3=1 then strftime(d,'%Y-%m-%d') else strftime(d,'%Y-%m-%d') end invoice_date, due_date,
  {money('total_amount')} total_amount,
  case when item_count>0 then concat('Order lines ', invoice_id) end item_description,
  case when item_count>0 then {money('subtotal')} end item_amount from inv"""
ORACLE["l_gst_to_core"] = f"""with {INV} select invoice_id, invoice_number, cast(null as varchar) vendor_name, 0 n_items,
  case when vendor_name is not null then concat(vendor_name, ' Ltd') end mapped_vendor,
  case when item_count>0 then 1 else 0 end mapped_items from inv"""
ENTITIES = (
    INV
    + """,
e0 as (select invoice_id, 0 ord, 'supplier_name' field, nullif(trim(vendor_name),'') v, vendor_name raw from inv
  union all select invoice_id, 1, 'customer_name', nullif(trim(buyer_name),''), concat(' ', buyer_name, ' ') from inv where buyer_name is not null
  union all select invoice_id, 1, 'customer_name', null, null from inv where buyer_name is null
  union all select invoice_id, 2, 'invoice_number', nullif(invoice_number,''), invoice_number from inv
  union all select invoice_id, 3, 'invoice_date', nullif(invoice_date,''), invoice_date from inv
  union all select invoice_id, 4, 'due_date', nullif(due_date,''), due_date from inv
  union all select invoice_id, 5, 'total_amount', cast(cast(total_amount as decimal(18,2)) as varchar),
    cast(cast(total_amount as decimal(18,2)) as varchar) from inv),
e1 as (select invoice_id, ord, field, v from e0
  union all select invoice_id, ord+100, field, case when raw is not null then rtrim(concat('second ', raw)) end from e0 where (invoice_id+ord)%8=0),
e2 as (select *, row_number() over (partition by invoice_id, field order by ord desc) rn from e1 where (invoice_id+ord)%10 > 7),
ids as (select invoice_id from inv),
ent as (select ids.invoice_id, max(v) filter (field='supplier_name') supplier_name, max(v) filter (field='customer_name') customer_name,
  max(v) filter (field='invoice_number') invoice_number, max(v) filter (field='invoice_date') invoice_date,
  max(v) filter (field='due_date') due_date, max(v) filter (field='total_amount') total_amount
  from ids left join (select * from e2 where rn=1) e2 on e2.invoice_id=ids.invoice_id group by 1)"""
)
ORACLE["l_entities"] = f"""with {ENTITIES} select invoice_id, supplier_name, customer_name, invoice_number, invoice_date,
  due_date, total_amount from ent"""
_ent_parts = ", ".join(
    f"""case when {f} is not null then concat('"{f}":"', {f}, '"') end"""
    for f in ("supplier_name", "customer_name", "invoice_number", "invoice_date", "due_date", "total_amount")
)
ORACLE["snk_gst_json"] = f"""with {ENTITIES} select invoice_id,
  concat('{{', array_to_string(list_filter([{_ent_parts}], lambda x: x is not null), ','), '}}') as json from ent"""

# Two-source merge
MERGED = f"{INV}, {SECOND}"


def _one_sided(field: str, left: str, right: str, lw: float, rw: float, blank: str, text: str = "::varchar") -> str:
    l_has, r_has = f"({left} is not null{blank.format(left)})", f"({right} is not null{blank.format(right)})"
    return (
        f"select invoice_id, '{field}' field_name, case when {r_has} then {right}{text} when {l_has} then {left}{text} end selected_value, "
        f"case when {l_has} then 'Google unavailable, using PDF' when {r_has} then 'PDF unavailable, using Google' "
        f"else 'Both sources missing' end selection_reason, "
        f"(case when {l_has} then {lw} when {r_has} then {rw} else 0.0 end)::double confidence_score, false is_mismatch "
        f"from pair where not ({l_has} and {r_has})"
    )


_blank = " and trim({0}) <> ''"
ORACLE["m_presence"] = "with " + MERGED + " " + " union all ".join(
    [
        _one_sided("invoice_number", "invoice_number", "invoice_number", 85.0, 95.0, _blank),
        _one_sided("vendor_name", "vendor_name", "r_vendor", 80.0, 90.0, _blank),
        _one_sided("vendor_address", "vendor_address", "vendor_address", 75.0, 85.0, _blank),
        _one_sided("buyer_name", "buyer_name", "r_buyer", 80.0, 90.0, _blank),
        _one_sided("buyer_address", "buyer_address", "buyer_address", 75.0, 85.0, _blank),
        _one_sided("invoice_date", "invoice_date", "invoice_date", 85.0, 95.0, _blank),
        _one_sided("due_date", "due_date", "due_date", 80.0, 90.0, _blank),
        _one_sided("currency", "currency", "currency", 90.0, 95.0, _blank),
        _one_sided("subtotal", "subtotal", "subtotal", 85.0, 90.0, ""),
        _one_sided("tax_amount", "tax_amount", "tax_amount", 85.0, 90.0, ""),
        _one_sided("total_amount", "total_amount", "r_total", 90.0, 95.0, ""),
        _one_sided("payment_terms", "payment_terms", "payment_terms", 70.0, 80.0, _blank),
        _one_sided("line_items", "item_count", "r_items", 75.0, 85.0, " and {0} > 0"),
    ]
)
DIFF = "(case when l<>0 then abs(r-l)/abs(l)*100 when r<>0 then 100.0 else 0.0 end)"
ORACLE["m_numeric"] = f"""with {MERGED}, a as (
  select invoice_id, 'subtotal' field_name, subtotal l, subtotal r, 90.0::double confidence_score from pair
  union all select invoice_id, 'tax_amount', tax_amount, tax_amount, 90.0 from pair
  union all select invoice_id, 'total_amount', total_amount, r_total, 95.0 from pair)
  select invoice_id, field_name, l::varchar pdf_value, r::varchar google_value, confidence_score, {DIFF}>5 is_mismatch,
  case when {DIFF}>5 then 'Manual review recommended' end recommendation from a where l is not null and r is not null"""
ORACLE["m_items"] = f"""with {MERGED} select invoice_id,
  case when r_items>0 then r_items when item_count>0 then item_count end::varchar selected_value,
  case when item_count>0 and r_items>0 then case when item_count>r_items
      then concat('PDF has more items, still using Google (Google=', r_items, ', PDF=', item_count, ')')
      when r_items>item_count then concat('Google has more items (', r_items, ' vs ', item_count, ')')
      else concat('Same count, preferring Google (', r_items, ' items)') end
    when item_count>0 then 'Google unavailable, using PDF' when r_items>0 then 'PDF unavailable, using Google'
    else 'Both sources missing' end selection_reason,
  (case when item_count>0 and r_items>0 then case when item_count>r_items then 75.0 when r_items>item_count then 90.0 else 85.0 end
    when item_count>0 then 75.0 when r_items>0 then 85.0 else 0.0 end)::double confidence_score,
  r_items>0 and item_count>r_items is_mismatch,
  case when r_items>0 and item_count>r_items then 'Item count mismatch, review recommended' end recommendation from pair"""
RIGHT_COMPLETE = (
    COMPLETE.replace("vendor_name", "r_vendor")
    .replace("buyer_name", "r_buyer")
    .replace("total_amount", "r_total")
    .replace("item_count", "r_items")
)
# In these tables two texts are either equal but for case or far apart, so no ratio is needed.
ORACLE["m_quality"] = f"""with {MERGED}, a as (select *, total_amount l, r_total r, {COMPLETE} lc, {RIGHT_COMPLETE} rc from pair),
  m as (select *, (case when lower(vendor_name)<>lower(r_vendor) then 1 else 0 end
    + case when l is not null and r is not null and {DIFF}>5 then 1 else 0 end + case when r_items>0 and item_count>r_items then 1 else 0 end) mm,
    (case when coalesce(invoice_number,'')<>'' then 1 else 0 end + case when coalesce(r_vendor,vendor_name) is not null then 1 else 0 end
    + case when coalesce(r,l) is not null then 1 else 0 end + case when coalesce(invoice_date,'')<>'' then 1 else 0 end)*25.0::double c from a)
  select invoice_id, cast(mm as integer) mismatch_count, greatest(0.0::double, c-mm*5) quality_score,
  case when c-mm*5>=85 then 'approve' when c-mm*5>=60 then 'review' else 'reject' end recommendation,
  printf('Quality Score: %.1f%% (Completeness=%.1f%%, Mismatches=%d)', greatest(0.0::double, c-mm*5), c, mm) note,
  cast(lc as integer) pdf_fields, cast(rc as integer) google_fields, case when rc>=6 then 85.0::double else 60.0::double end google_confidence from m"""
ORACLE["m_final"] = f"""with {MERGED} select invoice_id, nullif(invoice_number,'') invoice_number, coalesce(r_vendor, vendor_name) vendor_name,
  coalesce(r_buyer, buyer_name) buyer_name, due_date, currency, subtotal,
  case when r_items>0 then r_items when item_count>0 then item_count end item_count from pair"""

# Routing and documents
_best = "case when k%2=0 then 'google_document_ai' when k%3=0 then 'gemini_extraction' else 'pdf_extractor' end"
_asked = f"case k%5 when 0 then {_best} when 1 then 'google_document_ai' when 2 then 'gemini_extraction' when 3 then 'pdf_extractor' else %s end"
ORACLE["rt_method"] = f"""select k invoice_id, {_asked.replace('%s', "'pdf_extractor'")} service_method, {_asked.replace('%s', _best)} batch_method
  from (select o_orderkey k from orders)"""
ORACLE["rt_pick"] = f"""with {INV} select invoice_id,
  case when invoice_id%3<>0 then 'Google Document AI' when invoice_id%4<>0 then 'Gemini Extraction (Fallback)'
    else 'PDF Extractor (Emergency Fallback)' end model_used,
  case when invoice_id%3<>0 then 95.0::double when invoice_id%4<>0 then 85.0 else 0.0 end confidence,
  case when invoice_id%12=0 then 'Selected extraction failed' end error,
  case when invoice_id%3<>0 then 'google_document_ai' when invoice_id%4<>0 then 'gemini_extraction' else 'pdf_extractor' end as method,
  {money('case when invoice_id%3<>0 then total_amount when invoice_id%4<>0 then total_amount+1 else total_amount+2 end')} total_amount from inv"""
ORACLE["rt_pick_explicit"] = f"""with {INV} select invoice_id,
  case when invoice_id%4<>0 then 'Gemini Extraction' else 'PDF Extractor (Emergency Fallback)' end model_used,
  case when invoice_id%4<>0 then 90.0::double else 0.0 end confidence,
  case when invoice_id%4=0 then 'Selected extraction failed' end error,
  case when invoice_id%4<>0 then 'gemini_extraction' else 'pdf_extractor' end as method from inv"""
ORACLE["rt_documents"] = f"""with {TXT}, {EXTRACTED}, {rules('ext')}, {GATED},
  j as (select g.*, g.error is null and file_type='pdf' readable, v.invoice_number, v.vendor_name, v.total_amount, v.is_valid v_ok, v.score v_score,
    v.errors from gated g left join val v on v.invoice_id=g.file_id)
  select file_id, file_type, error is null success, error, case when readable then invoice_number end invoice_number,
  case when readable then vendor_name end vendor_name, case when readable then total_amount end total_amount,
  case when readable then v_ok when error is null then false end is_valid, case when readable then v_score when error is null then 0 end score,
  cast(case when readable then len(errors) when error is null then 1 end as integer) n_errors from j"""

# Streaming
ORACLE["ss_validate"] = f"with {VAL} select invoice_id, invoice_number, is_valid, score from val"
ORACLE["ss_dedup"] = """with recursive u as (select distinct concat('f', user_id, '.pdf') file_name, unnest(case when event_id%10=0
    then [ts, ts + interval 500 milliseconds] else [ts] end) ts from events),
  accepted(file_name, ts) as (select file_name, min(ts) from u group by 1 union all
    select a.file_name, min(u.ts) from accepted a join u on u.file_name = a.file_name and u.ts >= a.ts + interval 1 second
    group by a.file_name)
  select file_name, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') ts from accepted"""
