"""Word lists, character classes, patterns and texts that results depend on, as they are."""

# Letters that mark Vietnamese, and the patterns of headings and list items.
VI_LETTERS = "àáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹđĐ"
VI_CAPITALS = "ÀÁẠẢÃÂẦẤẬẨẪĂẰẮẶẲẴÈÉẸẺẼÊỀẾỆỂỄÌÍỊỈĨÒÓỌỎÕÔỒỐỘỔỖƠỜỚỢỞỠÙÚỤỦŨƯỪỨỰỬỮỲÝỴỶỸĐĐ"
SENTENCE_STARTS = "A-ZÁÀẮÂÉÈÊÔƠÚÙƯĐÍÌ"
HEADING_PATTERNS = (
    r"^(CHƯƠNG|PHẦN|MỤC|BÀI|TIẾT|PHỤLỤC|PHỤ LỤC)\s+[IVXLCDM\d]+",
    rf"^\d+\.\s+[A-Z{VI_CAPITALS}]",
    rf"^[IVXLCDM]+\.\s+[A-Z{VI_CAPITALS}]",
    r"^(CHAPTER|SECTION|PART|ARTICLE|APPENDIX)\s+[IVXLCDM\d]+",
    r"^\d+\.\s+[A-Z]",
    r"^[IVXLCDM]+\.\s+[A-Z]",
    r"^#{1,6}\s+",
    r"^[A-Z][A-Z\s]{2,}$",
    rf"^[A-Z{VI_CAPITALS}][A-Z{VI_CAPITALS}\s]{{2,}}$",
)
LIST_PATTERNS = (r"^[-•\*]\s+", r"^\d+[\.\)]\s+", r"^[a-zA-Z][\.\)]\s+", r"^[IVXLCDM]+[\.\)]\s+")
CODE_STARTS = ("```", "def ", "class ", "import ", "function ")
IMAGE_WORDS = ("hình", "ảnh", "biểu đồ", "chart", "figure", "graph", "diagram")
ENGLISH_MARKERS = ("speak", "english", "hello", "world", "the", "and", "is", "are", "this", "that", "with", "for")
SEPARATORS = ("\n\n\n", "\n\n", "\n", "。", "．", "！", "？", "；", ".", "!", "?", ";", ":", " ", "")
PUNCTUATION_TOKENS = ".,!?;:()[]{}\"'"
# fixed values
VI_WORDS = (
    "tôi", "bạn", "anh", "chị", "em", "mình", "ta", "họ", "ai", "gì", "là", "có", "được", "làm", "đi", "đến", "về", "xin", "chào", "tốt", "đẹp",
    "lớn", "nhỏ", "mới", "cũ", "và", "với", "từ", "để", "trong", "ngoài", "ạ", "ơi", "nhé", "rồi", "đã", "chưa", "lý", "viên", "công", "ty", "trợ",
    "giúp",
)
VI_ABBREVIATIONS = ("ai", "it", "hr", "ceo")
# fixed values
VI_STOPWORDS = (
    "và", "của", "cho", "được", "với", "các", "có", "trong", "đã", "những", "này", "về", "như", "là", "để", "theo", "tại", "từ", "không", "còn", "bị",
    "khi", "sẽ", "nhiều", "phải", "vì", "trên", "dưới", "nếu", "cần", "bởi", "lúc", "họ", "tôi", "anh", "chị", "nó", "một", "hai", "ba", "bốn", "năm",
    "sáu", "bảy", "tám", "chín", "mười",
)
# fixed values: the English stop words of a well-known natural-language toolkit
EN_STOPWORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've", "you'll", "you'd", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "she's", "her", "hers", "herself", "it", "it's", "its", "itself", "they", "them", "their",
    "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "that'll", "these", "those", "am", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as",
    "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during", "before", "after", "above",
    "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when",
    "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same",
    "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "don't", "should", "should've", "now", "d", "ll", "m", "o", "re", "ve", "y",
    "ain", "aren", "aren't", "couldn", "couldn't", "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't", "haven", "haven't",
    "isn", "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't", "needn", "needn't", "shan", "shan't", "shouldn", "shouldn't", "wasn", "wasn't",
    "weren", "weren't", "won", "won't", "wouldn", "wouldn't",
)
ALLOWED_EXTENSIONS = (".pdf", ".docx", ".txt", ".md", ".csv", ".html", ".htm")
MAX_UPLOAD_BYTES = 50 * 1024 * 1024
RECORD_TYPES = ("BloodGlucose", "BloodPressure")
PERIODS = ("before_breakfast", "after_breakfast", "before_lunch", "after_lunch", "before_dinner", "after_dinner", "before_sleep", "morning", "noon", "evening")
SUBTYPES = {"BloodGlucose": ("fasting", "postprandial", "null"), "BloodPressure": ("resting", "sitting", "standing", "null")}
NORMAL_RANGES = (("Blood Glucose", "fasting", 4.0, 7.0), ("Blood Glucose", "post_meal", 4.0, 10.0), ("Blood Pressure", "systolic", 90.0, 140.0), ("Blood Pressure", "diastolic", 60.0, 90.0))
DEFAULT_PROMPT = {
    "vi": ("Bạn là một trợ lý AI hữu ích. Hãy trả lời câu hỏi dựa trên thông tin được cung cấp.\n\nCâu hỏi: ", "\n\nContext: ", "\n\nHãy trả lời một cách chính xác và hữu ích."),
    "en": ("You are a helpful AI assistant. Please answer the question based on the provided information.\n\nQuestion: ", "\n\nContext: ", "\n\nPlease provide an accurate and helpful response."),
}
CLEAN_OUTPUT = {
    "vi": "\n\nQUAN TRỌNG: Hãy trả lời bằng văn bản thuần túy, sạch sẽ:\n- KHÔNG sử dụng markdown, HTML, hoặc format đặc biệt\n- KHÔNG sử dụng ký tự escape (\\n, \\t, etc.)\n- KHÔNG đặt text trong code blocks (```)\n- Chỉ sử dụng text thông thường, dễ đọc\n- Trả lời ngắn gọn, rõ ràng, chính xác",
    "en": "\n\nIMPORTANT: Please respond with clean, plain text only:\n- NO markdown, HTML, or special formatting\n- NO escape characters (\\n, \\t, etc.)\n- NO code blocks (```)\n- Use plain, readable text only\n- Keep response concise, clear, and accurate",
}
HISTORY_TITLE = {"vi": "Lịch sử cuộc trò chuyện:", "en": "Conversation history:"}
HISTORY_ROLES = {"user": "Người dùng", "assistant": "Trợ lý"}
TEMPLATE_ROLES = {"user": "User", "assistant": "Assistant"}
APOLOGY = {"vi": "Xin lỗi, tôi không thể tạo phản hồi phù hợp cho câu hỏi này.", "en": "Sorry, I couldn't generate an appropriate response for this question."}
NO_CONTEXT, NO_NOTE = "Không rõ", "Không có ghi chú."
FAILURE = {"vi": "Xin lỗi, tôi gặp sự cố khi tạo phản hồi. Vui lòng thử lại sau.", "en": "Sorry, I encountered an issue generating a response. Please try again later."}
