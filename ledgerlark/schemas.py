"""Schemas of the layers: extracted records (bronze), normalised records (silver), checks, and stored tables (gold)."""

EXTRACTED_ITEM = "struct<description:string,quantity:double,unit_price:double,line_total:double,tax_rate:double,confidence:double>"
EXTRACTED = f"""
vendor struct<name:string,tax_id:string,address:string,phone:string,email:string>,
invoice_number string, invoice_date string, due_date string, currency string, purchase_order string,
payment_terms string, subtotal double, tax_amount double, discount_amount double, grand_total double,
line_items array<{EXTRACTED_ITEM}>, confidence double"""

NORMALIZED_ITEM = (
    "struct<description:string,quantity:decimal(18,4),unit_price:decimal(18,4),line_total:decimal(18,2),"
    "tax_rate:decimal(14,4),confidence:double,sort_order:int,unit_price_derived:boolean,line_total_derived:boolean>"
)

CHECK = "struct<seq:int,name:string,status:string,field:string,message:string,expected:string,actual:string>"

DOCUMENTS = (
    "id string, filename string, mime_type string, file_size_bytes int, file_path string, file_hash string, status string, "
    "raw_ocr_text string, source_type string, created_at timestamp, updated_at timestamp"
)
VENDORS = "id string, name string, tax_id string, address string, phone string, email string, created_at timestamp, updated_at timestamp"
INVOICES = (
    "id string, document_id string, vendor_id string, invoice_number string, invoice_date date, due_date date, "
    "subtotal decimal(14,2), tax_amount decimal(14,2), discount_amount decimal(14,2), grand_total decimal(14,2), currency string, "
    "vendor_name string, vendor_tax_id string, vendor_address string, status string, composite_confidence decimal(5,4), "
    "extraction_model string, raw_extraction_json string, created_at timestamp, updated_at timestamp"
)
ITEMS = (
    "id string, invoice_id string, description string, quantity decimal(12,4), unit_price decimal(14,4), line_total decimal(14,2), "
    "tax_rate decimal(6,4), discount decimal(14,2), product_sku string, sort_order int"
)
LOGS = "id string, document_id string, stage string, status string, message string, payload string, duration_ms int, created_at timestamp"

ANNOTATION = (
    "struct<text:string,pages:array<struct<blocks:array<struct<paragraphs:array<struct<words:array<struct<"
    "symbols:array<struct<text:string>>,confidence:double,boundingBox:struct<vertices:array<struct<x:double,y:double>>>>>>>>>>>>"
)
TOKEN = "struct<text:string,confidence:double,x0:double,y0:double,x1:double,y1:double,page:int>"
OCR_RESULT = f"text string, source_type string, page_count int, mean_confidence double, tokens array<{TOKEN}>, error string"
LLM_RESPONSE = "raw string, model string, finish_reason string, input_tokens int, output_tokens int, duration_ms int, error string"
