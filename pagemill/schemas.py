"""Schemas of the tables between stages, as DDL."""

WORDS = "source_doc string, page_no int, page_height double, word_ord int, text string, x0 double, x1 double, top double, bottom double"
_META = "lco string, title string, applicability string"
_SOURCE = "source_doc string, source_pages array<int>"
ACTION = "struct<id:int,gid:string,label:string,`group`:int,alt:int,connector:string,optional:boolean,text:string,completion_time:string,note:string,refs:array<string>>"
PAGES = (
    "lco string, title string, lco_stmt string, applicability string, cond_bands array<struct<letter:string,text:string,optional:boolean,compound:boolean>>, "
    "act_items array<struct<type:string,label:string,note:string,text:string,ct:string,optional:boolean,refs:array<string>>>, raw_text string, page_no int, source_doc string"
)
RAW = "id string, metadata struct<lco:string,title:string,applicability:string,source_doc:string,source_pages:array<int>>, raw_text string"
QUESTIONS = "id string, type string, question string, evidence_keywords array<array<string>>, evidence_units array<string>, evidence_ids array<string>"
RUNS = "qa_id string, question string, qa_type string, strategy string, top_k int, results array<struct<rank:int,score:double,chunk_id:string,evidence_ids:array<string>,body:string,metadata:struct<lco:string,chunk_type:string>>>"
