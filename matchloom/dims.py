"""Fixed values of the matching rules: word lists, patterns, weights and thresholds, and the tables made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Headings of each section, as phrases in small letters.
SECTION_ALIASES: dict[str, tuple[str, ...]] = {
    "skills": (
        "skills", "technical skills", "core skills", "key skills", "tech stack", "technologies", "tools & technologies", "tools and technologies", "competencies", "core competencies", "areas of expertise",
        "proficiencies", "technical proficiencies", "skill set", "skillset", "technical expertise", "programming languages", "languages and tools", "software skills", "it skills", "technical competencies",
        "computer skills", "professional skills", "relevant skills", "functional skills", "tools", "frameworks", "platforms", "databases", "devops tools", "cloud technologies", "data tools", "soft skills",
        "interpersonal skills", "technical knowledge", "domain expertise", "technology stack", "tech skills", "key technologies", "skills & abilities", "skills and abilities", "skills & expertise",
        "skills and expertise", "expertise", "areas of knowledge",
    ),
    "experience": (
        "experience", "work experience", "professional experience", "employment history", "work history", "career history", "professional background", "employment", "relevant experience", "industry experience",
        "job history", "positions held", "professional history", "working experience", "career experience", "internship experience", "internships", "past employment", "previous roles", "previous positions",
        "roles", "career profile", "career path", "work record", "summary of experience", "experience summary", "employment record", "job experience", "work details", "professional roles", "where i have worked",
        "where i worked",
    ),
    "education": (
        "education", "educational background", "academic background", "academic qualifications", "qualifications", "educational qualifications", "degrees", "academic details", "education & training",
        "education and training", "academic record", "educational history", "academic history", "scholastic record", "academic credentials", "my academic credentials", "educational credentials", "studies",
        "academic profile", "degree details", "university education", "college education", "school education", "coursework", "relevant coursework", "academic achievements", "educational details",
        "scholastic details", "academic summary",
    ),
    "summary": (
        "summary", "professional summary", "executive summary", "career summary", "profile", "profile summary", "what i bring to the table", "about me", "personal statement", "overview", "introduction",
    ),
    "objective": ("career objective", "objective", "career goal", "professional objective"),
    "projects": ("projects", "project experience", "key projects", "personal projects", "academic projects", "notable projects", "side projects", "major projects"),
    "certifications": (
        "certifications", "certificates", "professional certifications", "licenses & certifications", "licenses and certifications", "training & certifications", "training and certifications", "certification",
        "professional development", "training",
    ),
    "achievements": ("achievements", "accomplishments", "awards", "awards & honors", "awards and honors", "honors", "recognition", "key achievements"),
    "contact": ("contact", "contact information", "contact details", "personal information", "personal details"),
    "responsibilities": ("responsibilities", "key responsibilities", "roles and responsibilities", "roles & responsibilities", "job responsibilities", "duties", "duties and responsibilities"),
    "requirements": (
        "requirements", "job requirements", "minimum requirements", "required qualifications", "desired qualifications", "preferred qualifications", "must have", "nice to have", "eligibility",
        "minimum qualifications", "basic qualifications",
    ),
    "about": ("about us", "about the company", "company overview", "about the role", "job description", "role overview", "position overview", "job overview"),
    "other": (
        "references", "hobbies", "interests", "hobbies & interests", "extracurricular", "volunteer", "volunteer experience", "publications", "languages", "additional information", "extra curricular activities",
        "activities", "memberships",
    ),
}

# Wrongly decoded sequences and what they stand for, in order.
MOJIBAKE: tuple[tuple[str, str], ...] = (
    ("â\u0080\u0099", "'"), ("â\u0080\u0098", "'"), ("â\u0080\u009c", '"'), ("â\u0080\u009d", '"'), ("â\u0080\u0094", "—"), ("â\u0080\u0093", "–"), ("â\u0080¦", "…"),
    ("Ã©", "é"), ("Ã¨", "è"), ("Ã¼", "ü"), ("Ã¶", "ö"), ("Ã¤", "ä"), ("Ã±", "ñ"),
)

# Words that carry no content in a comparison of terms.
STOP_WORDS = (
    "and or the in with for to of a an is at by from on as experience years skills knowledge strong proficient responsible working work role job etc including using must have required requirement requirements "
    "responsibilities about us overview seeking platform we are our you will degree field related candidate ability abilities demonstrated"
).split()

# Parts of words that show a requirement.
REQUIREMENT_KEYWORDS = (
    "experience skill proficien knowledge degree bachelor master docker python cloud aws gcp kubernetes database sql microservice architecture develop manage lead years must required essential familiar preferred"
).split()

# Abbreviations after which a full stop and a blank end no sentence.
ABBREVIATIONS = (
    "mr mrs ms dr sr jr prof dept inc ltd corp assoc mgr engr pvt st ave blvd rd jan feb mar apr jun jul aug sep sept oct nov dec vol rev gen gov sgt cpl capt lt col approx est min max avg no nos ref tel fax ext fig eq ch sec pt"
).split()
SPECIAL_ABBREVIATIONS = r"e\.g|i\.e|vs|etc|approx|est|al"
JS_NAMES = "node|vue|react|next|express|d3|three|angular|jquery"

# Headings at a text's start that are no part of what is embedded; the first that matches goes.
HEADING_PREFIX = (
    r"skills\s*(?:&|and)?\s*expertise|technical\s*skills|core\s*skills|key\s*skills|skills|work\s*experience|professional\s*experience|employment\s*history|experience|education|academic\s*background"
    r"|educational\s*qualifications|professional\s*summary|executive\s*summary|summary|career\s*summary|objective|requirements|responsibilities|role\s*overview|about\s*us|where\s*i\s*have\s*worked"
    r"|my\s*academic\s*credentials|what\s*i\s*bring\s*to\s*the\s*table|areas\s*of\s*expertise"
)

# Words that make a requirement mandatory.
MANDATORY = r"must\s+have|must\s+possess|required|requirement|mandatory|essential|minimum|at\s+least|necessary|compulsory|obligatory|non[- ]?negotiable"

# What in a block's text points to a section, in order: section, reason, pattern (case doesn't matter).
_W, _E = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
SIGNALS: tuple[tuple[str, str, str], ...] = (
    ("experience", "date range", _W + r"\d{4}\s*[-–—]\s*(?:\d{4}|present|current|till date)" + _E),
    ("experience", "employment words", _W + r"(?:worked at|worked with|employed at|joined|role|position|designation|responsibilities|duties|client|employer|tenure)" + _E),
    ("experience", "job titles", _W + r"(?:software engineer|developer|architect|team lead|tech lead|engineering manager|product manager|data scientist|data engineer|devops engineer|consultant|analyst|specialist|administrator|intern|associate|director|vp|vice president)" + _E),
    ("experience", "action verb first", r"(?:^|\n)\s*[-*•]?\s*(?:managed|spearheaded|architected|developed|implemented|designed|coordinated|collaborated|delivered|engineered|optimized|resolved|maintained|deployed|monitored|increased|reduced|achieved|drove|trained|mentored|led)" + _E),
    ("education", "degrees", _W + r"(?:bachelor|master|ph\.?d|diploma|degree|b\.?tech|m\.?tech|b\.?sc|m\.?sc|b\.?e|m\.?e|mba|bba|bca|mca|b\.?a|m\.?a|b\.?com|m\.?com|associate degree|doctorate|post graduate|undergraduate)" + _E),
    ("education", "institutions and grades", _W + r"(?:university|college|institute|school|academy|campus|cgpa|gpa|percentage|grade|marks|graduated|class of|batch of|passout)" + _E),
    ("education", "fields of study", _W + r"(?:computer science|information technology|electronics|electrical|mechanical|civil engineering|data science|artificial intelligence|business administration|mathematics|statistics|physics)" + _E),
    ("skills", "list of items", r"(?:[\p{L}\p{N}_+#.]+\s*[,|/]\s*){3,}"),
    ("skills", "technical terms", _W + r"(?:python|java|c\+\+|javascript|typescript|golang|rust|ruby|php|swift|kotlin|react|angular|vue|next\.?js|node\.?js|express|django|fastapi|flask|spring boot|docker|kubernetes|aws|azure|gcp|terraform|git|linux|sql|postgresql|mysql|mongodb|redis|elasticsearch|kafka|graphql|rest api|ci/cd|html|css|tailwind)" + _E),
    ("contact", "e-mail address", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"),
    ("contact", "phone number", r"(?:\+?\d{1,3}[\s\-]?)?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{4}"),
    ("contact", "profile address", _W + r"(?:linkedin\.com/in/|github\.com/|[a-z0-9]+\.github\.io)"),
    ("certifications", "certificates", _W + r"(?:certified|certification|certificate|credential|license|aws certified|google certified|microsoft certified|pmp|scrum master|itil|cka|ckad|cissp)" + _E),
    ("projects", "project words", _W + r"(?:project|built|developed|implemented|created|designed|github|repository|demo|prototype|tech stack used)" + _E),
    ("achievements", "awards", _W + r"(?:award|recognition|achievement|honor|prize|medal|top performer|outstanding|excellence|hackathon winner|rank)" + _E),
    ("summary", "summary phrases", _W + r"(?:experienced professional|results-driven|proven track record|seeking an opportunity|dynamic and motivated|passionate engineer)" + _E),
)

# Where in a document a section is expected.
POSITION_PRIORS: tuple[tuple[str, float, float], ...] = (
    ("contact", 0.0, 0.15), ("summary", 0.0, 0.25), ("objective", 0.0, 0.25), ("skills", 0.1, 0.6), ("experience", 0.2, 0.9), ("education", 0.5, 1.0), ("projects", 0.3, 0.9), ("certifications", 0.6, 1.0), ("achievements", 0.5, 1.0),
    ("content", 0.0, 1.0),
)

# What each score is made of: sections of the query document, weight of the mean and of the coverage.
COMPONENTS: dict[str, tuple[str, ...]] = {
    "skill": ("skills", "projects", "certifications", "requirements"),
    "work_experience": ("experience", "projects", "achievements", "responsibilities"),
    "education": ("education", "certifications"),
}
CONTENT_EXCLUDES = ("skills", "experience", "education", "contact")
#: Similarity below which a pair without a common term counts as noise, by the query block's section.
GATES = {"skills": 0.70, "requirements": 0.70, "experience": 0.52, "responsibilities": 0.52, "education": 0.55}
GATE_ELSE = 0.48

SECTIONS = "contact summary objective skills experience education projects certifications achievements responsibilities requirements about content other unknown".split()


def aliases(spark: SparkSession) -> DataFrame:
    """alias, section: a fixed table of 191 rows, always small enough to broadcast."""
    return spark.createDataFrame([(a, s) for s, names in SECTION_ALIASES.items() for a in names], "alias string, section string")
