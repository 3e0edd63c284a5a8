"""Words, bands and limits that results depend on."""

# --- fixed values: words that the duplicate check leaves out -------------------------------------
STOPWORDS = [
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "of", "to", "in", "on", "at", "by", "for", "with",
    "from", "and", "or", "not", "no", "this", "that", "these", "those", "it", "its", "as", "which", "one", "following",
    "correct", "correctly", "incorrect", "statement", "statements", "given", "below", "above", "true", "false", "select",
    "choose", "regarding", "about", "consider", "identify", "list", "lists", "match", "matching", "column", "columns", "answer",
    "answers", "option", "options", "only", "most", "appropriate", "light", "ii", "iii", "iv", "vi", "vii", "viii",
]

# --- fixed values: words that speak for a subject ------------------------------------------------
BIOLOGY_WORDS = [
    "cell", "plant", "animal", "photosynthesis", "respiration", "dna", "rna", "protein", "enzyme", "chromosome", "mitosis",
    "meiosis", "ecology", "evolution", "biodiversity", "kingdom", "phylum", "species", "organism", "tissue", "organ", "blood",
    "heart", "nerve", "hormone", "reproduction", "genetics", "mutation",
]
CHEMISTRY_WORDS = [
    "mole", "atom", "molecule", "reaction", "acid", "base", "salt", "bond", "orbital", "electron", "proton", "neutron",
    "element", "compound", "solution", "concentration", "equilibrium", "oxidation", "reduction", "polymer", "organic", "alkane",
    "alkene", "benzene", "ester", "ether",
]
PHYSICS_WORDS = [
    "force", "velocity", "acceleration", "momentum", "energy", "power", "wave", "frequency", "current", "voltage", "resistance",
    "magnetic", "electric", "gravitational", "temperature", "pressure", "volume", "mass", "charge", "field", "lens", "mirror",
    "refraction",
]

# --- fixed values: words that make a question complex --------------------------------------------
COMPLEX_WORDS = ["explain", "compare", "solve", "mechanism", "difference", "derive", "describe", "elaborate", "distinguish", "why", "how does", "what happens", "process of", "steps", "diagram"]
COMPLEX_LENGTH = 12

# --- fixed values: (least score, first rank, last rank, percentile) ------------------------------
RANK_BANDS = [
    (680, 1, 50, 99.99),
    (660, 51, 300, 99.97),
    (640, 301, 800, 99.93),
    (620, 801, 2000, 99.85),
    (600, 2001, 5000, 99.60),
    (580, 5001, 10000, 99.20),
    (560, 10001, 20000, 98.60),
    (540, 20001, 35000, 97.70),
    (520, 35001, 55000, 96.40),
    (500, 55001, 78000, 94.70),
    (480, 78001, 105000, 92.60),
    (460, 105001, 140000, 89.90),
    (440, 140001, 180000, 86.80),
    (420, 180001, 225000, 83.20),
    (400, 225001, 280000, 78.80),
    (380, 280001, 345000, 73.50),
    (360, 345001, 420000, 67.40),
    (340, 420001, 510000, 60.30),
    (300, 510001, 700000, 49.00),
    (0, 700001, 2200000, 28.00),
]
FULL_SCORE = 720

# --- fixed values: noise of exam papers, removed in this order -----------------------------------
PAGE_NOISE = [r"SPACE FOR ROUGH WORK[^\n]*\n", r"www\.\S+", r"Download From[^\n]*\n", r"Page \d+[^\n]*\n"]

# --- fixed values: patterns of exam papers, by format: where questions begin, their number, answers, options, where an explanation begins ----
PAPER_BEGIN = {"standard": r"\n(?=\d+\.[\s\n])", "sol": r"\n\s*\n\s*(?=\d+\.)", "q_format": r"\n(?=Q\.\d+\s)", "abcd_inline": r"\n(?=\s*\d+\.)"}
PAPER_NUMBER = {"standard": r"^(\d+)\.\s*", "sol": r"^(\d+)\.\s*", "q_format": r"^Q\.(\d+)\s*", "abcd_inline": r"^(\d+)\.\s*"}
PAPER_ANSWER = {
    "standard": r"(?i)Ans\.\s*[\(\[]?([1-4abcd])[\)\]]?",
    "sol": r"(?i)(?:Ans(?:wer)?|Sol)\s*[\.\:]?\s*[\(\[]?([1-4abcd])[\)\]]?",
    "q_format": r"Ans\.\s*\[([1-4])\]",
    "abcd_inline": r"(?i)(?:Ans(?:wer)?)\s*[\.\:]?\s*([a-d])",
}
PAPER_OPTIONS = {
    "standard": [r"^\(([1-4])\)\s*(.*)", r"(?i)^([a-d])\.\s*(.*)"],
    "sol": [r"^\(([1-4])\)\s*(.*)", r"(?i)^([a-d])\.\s*(.*)"],
    "q_format": [r"^\(([1-4])\)\s*(.*)"],
    "abcd_inline": [r"(?i)^([a-d])\.\s+(.*)"],
}
PAPER_STOP = {"sol": r"(?i)Sol\.|Solution|Students find", "q_format": r"(?i)^Sol\.|^Solution"}
PAPER_LAST_NUMBER = 200
QUESTION_LENGTH = 20

# --- fixed values: headers, items and endings of list questions, labels of statements -----------------------------------------------------
LIST_HEADER = r"(?i)(list|column)\s*[-–—\s]*\b(I{1,2})\b"
LIST_REPEATED_HEADER = r"(?i)\s*[;,.]?\s*(list|column)\s*[-–—\s]*I{1,2}\s*(\[[^\]]*\])?\s*:?\s*$"
LIST_TRAILER = r"(?i)\b(choose|select|identify)\b"
STATEMENT_LABEL = r"(?i)\b(?:assertion\s*\(?\s*[a-z]?\s*\)?|reason\s*\(?\s*[a-z]?\s*\)?|statements?\s*[-\s]*(?:[ivx]{1,3}|[a-h]|\d{1,2}))\s*:"
STATEMENT_TRAILER = r"(?i)\b(in the light of|choose|select|identify)\b"

# --- fixed values: limits ------------------------------------------------------------------------
PAGE_SIZE = 50
FREE_TOKENS, GUEST_TOKENS = 20_000, 5_000
DIGITS, DEVANAGARI = "0123456789", "०१२३४५६७८९"
SAMPLE_SIZES = {"Biology": 90, "Physics": 45, "Chemistry": 45}
DIAGRAM_MARKER = "<<<DIAGRAM_HERE>>>"
