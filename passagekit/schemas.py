"""Declared schemas, as DDL text, of the tables the operators exchange."""

PARAGRAPHS = (
    "paper_paragraph_id string, paragraph_text string, corpusid long, arxiv string, shard int"
)
PAPER_METADATA = "id string, categories string, update_date date"
VECTORS = "vec_id string, vector array<float>"
QUESTIONS = (
    "patent_id string, patent_title string, patent_abstract string, cpc_class string, "
    "is_computer_science_patent boolean, question_id string, question string"
)

PARAGRAPH_ENTRY = (
    "struct<paragraph_id:string,rank:int,has_paragraph:boolean,paragraph_text:string,"
    "contains_answer:string,answer:string,paragraph_type:string,rerank_score:double,error:string>"
)
PAPER_ENTRY = (
    "struct<paper_id:string,metadata:map<string,string>,paragraphs:array<" + PARAGRAPH_ENTRY + ">>"
)
QUESTION_ENTRY = (
    "struct<question:string,retrieved_papers:array<" + PAPER_ENTRY + ">,stats:map<string,bigint>>"
)
RESULT_BODY = (
    "struct<cpc:string,grant_year:int,patent_title:string,patent_abstract:string,"
    "first_question:int,question_types:map<string,array<" + QUESTION_ENTRY + ">>>"
)
RESULT_DOCUMENT = (
    "patent_id string, cpc string, grant_year int, patent_title string, patent_abstract string, "
    "first_question int, question_types map<string,array<" + QUESTION_ENTRY + ">>"
)
RESULTS_FLAT = (
    "patent_id string, qtype string, q_idx int, question string, paper_idx int, paper_id string, "
    "para_idx int, paragraph_id string, rank int, paragraph_text string, contains_answer string, "
    "answer string, error string, rerank_score double"
)

FLAT_COLUMNS = [field.split()[0] for field in RESULTS_FLAT.split(", ")]

#: Question identity; positions are part of the key, never row order.
QUESTION_KEY = ["patent_id", "qtype", "q_idx"]
POSITION_KEY = [*QUESTION_KEY, "paper_idx", "para_idx"]
LEVELS = ["remembering", "understanding"]
