"""Fixed values that results depend on.  Tuples keep their order where order decides."""

# Complexity levels and the score from which a tier is full.
LEVELS = {"low": 1.3, "medium": 1.6, "high": 2.0}
FULL_TIER = 1.5

# Prefixes and their factors, first match wins.
PREFIXES = (
    ("psycho", 1.4), ("neuro", 1.4), ("crypto", 1.4), ("pseudo", 1.35), ("proto", 1.35), ("macro", 1.3), ("micro", 1.3), ("ortho", 1.3),
    ("hetero", 1.3), ("homeo", 1.3), ("thermo", 1.3), ("electro", 1.3), ("inter", 1.25), ("intra", 1.25), ("retro", 1.25), ("extra", 1.25),
    ("ultra", 1.25), ("hyper", 1.25), ("hypo", 1.25), ("anti", 1.2), ("auto", 1.2), ("semi", 1.2), ("poly", 1.2), ("mono", 1.2),
    ("omni", 1.2), ("trans", 1.15), ("pre", 1.1), ("post", 1.1), ("sub", 1.1), ("super", 1.1), ("over", 1.05), ("under", 1.05),
)

# Suffixes and their factors, first match wins.
SUFFIXES = (
    ("aceous", 1.35), ("iferous", 1.35), ("itious", 1.35), ("ology", 1.3), ("ography", 1.3), ("escence", 1.3), ("escent", 1.3), ("atory", 1.25),
    ("itive", 1.25), ("ative", 1.25), ("ulent", 1.25), ("ulous", 1.25), ("ivity", 1.2), ("uous", 1.2), ("eous", 1.2), ("ious", 1.2),
    ("ance", 1.15), ("ence", 1.15), ("ment", 1.15), ("ness", 1.1), ("ful", 1.1), ("less", 1.1),
)

# Letter clusters and their factors, the largest counts.
CLUSTERS = (
    ("polis", 1.25), ("fect", 1.2), ("que$", 1.25), ("ieu", 1.25), ("eau", 1.25), ("oise|ois", 1.3), ("ariat", 1.2), ("ps", 1.2),
    ("stle", 1.15), ("ght", 1.15), ("xc", 1.15),
)

# Science suffixes.
SCIENCE_SUFFIXES = (
    "ology", "ologist", "ological", "itis", "osis", "oses", "asis", "emia", "aemia", "oma", "omas", "omata", "pathy", "pathic", "plasty",
    "ectomy", "ostomy", "otomy", "scopy", "scope", "graphy", "graph", "metry", "meter", "genesis", "genic", "lysis", "lytic", "trophy",
    "trophic", "phage", "phagy", "cytosis", "cyte", "plasm", "plasmic", "philic", "philia", "phile", "phobic", "phobia", "toxic", "toxin",
    "ase", "zyme", "peptide", "protein", "steroid", "hormone", "receptor", "ligand", "kinase", "phosphatase", "oxide", "hydroxide",
    "chloride", "sulfate", "phosphate", "carbonate", "amine", "amide", "aldehyde", "ketone", "alcohol", "ether", "polymer", "monomer",
    "catalyst", "ism", "ist", "ium", "ion", "ation", "ization",
)

# Drug stems.
DRUG_STEMS = (
    "mab", "umab", "zumab", "ximab", "vir", "navir", "fovir", "statin", "olol", "pril", "april", "cillin", "mycin", "micin", "cycline",
    "profen", "oxicam", "fenac", "azole", "afungin", "kinib", "tinib", "zomib", "rafenib", "lenib",
)

# Abbreviations before which a sentence does not end.
ABBREVIATIONS = (
    "vs?", "v", r"e\.g", r"i\.e", "etc", "no", "vol", "fig", "dept", "approx", "est", "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep",
    "Oct", "Nov", "Dec", "Dr", "Mr", "Mrs", "Ms", "Prof", "Sr", "Jr", "Lt", "Capt", "Sgt", "Rep", "Sen", "Gov", "al",
)

# Title abbreviations inside a phrase, words that end a phrase, and determiners.
TITLES = frozenset("dr mr mrs ms prof sr jr vs etc inc ltd dept est vol no fig ref approx govt al".split())
BREAKERS = frozenset(
    "in on at by to of or and but for nor yet so as if than then when where with from into onto upon over under after before since until while about "
    "against between through during without within along across behind beyond except toward towards around among per".split()
)
DETERMINERS = frozenset(("the", "a", "an", "this", "that", "these", "those"))

# Tags by role.
NOISE_TAGS = ("figure", "figcaption", "aside", "nav", "header", "footer", "blockquote", "table", "form", "menu")
BLOCKED_TAGS = ("script", "style", "noscript", "textarea", "input", "code", "pre", "nav", "header", "footer", "aside", "button", "table", "select", "svg")
ALLOWED_TAGS = ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "article", "main", "section", "div", "span")
BLOCK_TAGS = (
    "p", "div", "li", "td", "th", "blockquote", "section", "article", "main", "header", "footer", "aside", "h1", "h2", "h3", "h4", "h5", "h6",
    "dt", "dd", "figcaption",
)

# Weights of vocabulary branches.
BRANCH_WEIGHTS = {"A": 1.2, "B": 1.3, "C": 1.5, "D": 1.4, "E": 1.1, "F": 1.1, "G": 1.3, "H": 0.9, "I": 0.8, "J": 0.9, "N": 1.0}

#: Default dictionaries; any other lists can be passed in.
STOP_WORDS = tuple(
    "the a an and or but nor so yet for of to in on at by with from into onto over under up down out off as is are was were be been being am do does did "
    "have has had having it its this that these those he she they we you i me him her them us my your his their our who whom which what when where why how "
    "not no yes if then than too very can could may might must shall should will would there here all any both each few more most other some such only own "
    "same about after again against before below between during through until while because us".split()
)
STARTERS = tuple("however therefore furthermore additionally moreover nevertheless meanwhile consequently although whereas finally overall first second third next thus hence".split())
