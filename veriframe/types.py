"""Schemas of the claim-verification tables, as Spark DDL."""

PERIOD = "struct<kind:string,year:int,quarter:int,months:int,end_date:date,label:string>"
QUANTITY = f"struct<value:double,unit:string,scale:double,period:{PERIOD},basis:string,raw:string>"
CLAIMS = f"claim_id bigint, text string, value {QUANTITY}, operation string, period {PERIOD}, basis string"
EVIDENCE = f"claim_id bigint, quantities array<{QUANTITY}>, covered_periods array<{PERIOD}>, doc_id string, node_ids array<string>, citation_url string, quote string"
MANIFEST = "doc_id string, role string, type string, period string, url string"
DOCUMENT = "doc_id string, doc_type string, markdown string, anchors map<int,string>, pages map<int,int>, sha256 string"
ADDRESS = "struct<line_start:int,line_end:int,anchor:string,page_start:int,page_end:int>"
FINDING = "struct<claim_index:int,verdict:string,claimed:string,found:string,resolved:string,basis:string,reasoning:string,quote:string,doc_id:string,node_ids:array<string>>"
FIGURE_FINDING = "struct<claim_index:int,figures:array<struct<raw:string,label:string,unit:string,period:string>>,doc_id:string,node_ids:array<string>,quote:string>"
TAGGED_CLAIM = "text string, figure string, value double, scale string, unit string, operation string, period string, section string"

STATUSES = ("SUPPORTED", "CONTRADICTED", "BASIS_MISMATCH", "NO_EVIDENCE", "NO_SOURCE")
RUN_FAILED = "RUN_FAILED"
UNITS = ("USD", "percent", "count", "ratio")
BASES = ("GAAP", "non-GAAP", "adjusted", "ARR", "product revenue", "unknown")
PERIOD_KINDS = ("FY", "Q", "months_ended")
OPERATIONS = ("absolute", "growth", "margin")
