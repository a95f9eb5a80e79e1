"""Relations the operators work on, as DDL strings Spark accepts anywhere a schema is expected."""

APPLICANTS = "applicant_id long, age int, education string, language_score double, work_experience int"
SUBMITTED = "applicant_id long, doc string"
MESSAGES = "conv_id long, turn long, role string, parts array<string>, content string"
CONVERSATION_DOCS = "conv_id long, doc_id long"
UPLOADS = "doc_id long, name string, content string"
PAGES = "page_id long, url string, html string"
LINKS = "page_id long, pos int, link string"
RESPONSES = "doc_id long, response string"
STATUS_PAGES = "case_key long, status_code int, html string"
ELEMENTS = "doc_id long, page_no int, elem_no long, elem_type string, y0 double, y1 double, text string"
PAGE_TABLES = "doc_id long, page_no int, table_no int, bbox_bottom double, cells array<array<string>>"
PAGE_BOXES = "doc_id long, page_no int, page_h double"
CELL_ROWS = "doc_id long, page_no int, table_no int, row_no long, cells array<string>"
TABLE_TEXTS = "table_id string, text string"
SUBMISSIONS = "sub_id long, nom string, email string, telephone string, sujet string, message string"

# The keys of the report a model is asked to return.
REPORT = (
    "`sujets_principaux` array<string>, "
    "`thèmes_clés` array<struct<`thème`: string, `description`: string, `sujets_connexes`: array<string>>>, "
    "`points_de_données_significatifs` array<struct<`point_de_donnée`: string, `contexte`: string, `source`: string>>, "
    "`insights` array<struct<`insight`: string, `explication`: string>>"
)
