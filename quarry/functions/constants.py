"""Word lists, patterns and maps that results depend on."""

# fixed values, in natural order
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on",
    "that", "the", "to", "was", "will", "with",
)
NULL_TOKENS = ("nan", "none", "null", "", "nil", "n/a", "na", "-", "--")
FIELD_BOOSTS = {"title": 3.0, "content": 2.0, "full_text": 1.0}
CATEGORY_TERMS = {
    "risk reduction": ("risk reduction", "prevention", "mitigation"),
    "insurance penetration": ("penetration", "insurance", "coverage"),
    "risk financing": ("financing", "funding", "capital"),
}
FILTER_LABELS = {
    "solution_category": {
        "natural-catastrophe": "Natural Catastrophe", "cyber": "Cyber", "health": "Health", "retirement": "Retirement",
        "mortality": "Mortality",
    },
    "solution_type": {
        "risk-reduction": "Risk Reduction", "risk-financing": "Risk Financing",
        "increase-penetration": "Increase Penetration", "raising-awareness": "Raising Awareness",
        "leveraging-technology": "Leveraging Technology", "regulation": "Regulation",
    },
    "countries": {
        "thailand": "Thailand", "singapore": "Singapore", "malaysia": "Malaysia", "indonesia": "Indonesia",
        "philippines": "Philippines", "vietnam": "Vietnam", "myanmar": "Myanmar", "cambodia": "Cambodia", "laos": "Laos",
        "brunei": "Brunei",
    },
}
SCORING = {
    "weights": {"keyword": 0.6, "vector": 4.16, "graph": 0.5},
    "normalization": {"log_scale_factor": 1.0, "rank_weight": 0.3, "min_percentile": 1, "max_percentile": 99},
    "result_limits": {"max_results": 50, "max_per_source": 100},
    "confidence_thresholds": {"high": 0.3, "medium": 0.1},
    "performance": {"search_timeout": 30, "max_retries": 3, "parallel_search": True},
}
ABBREVIATIONS = (
    "Mr", "Mrs", "Ms", "Dr", "Prof", "Sr", "Jr", "vs", "etc", "Inc", "Corp", "Ltd", "Co", "St", "Ave", "Blvd", "Rd",
    "Fig", "Table", "Ch", "Sec", "Vol", "No", "pp", "cf", "i.e", "e.g", "et al",
)
TITLES = ("Dr.", "Prof.", "Mr.", "Ms.", "Mrs.", "Dr", "Prof", "Mr", "Ms", "Mrs")
ORG_ABBREVIATIONS = {
    "Intergovernmental Panel on Climate Change": "ipcc", "United Nations": "un", "World Bank": "world_bank",
    "International Monetary Fund": "imf", "Environmental Protection Agency": "epa",
    "National Aeronautics and Space Administration": "nasa",
}
PREFIXES = {
    "kr": "http://example.org/schema#", "foaf": "http://xmlns.com/foaf/0.1/",
    "schema": "https://schema.org/", "dcterms": "http://purl.org/dc/terms/",
    "skos": "http://www.w3.org/2004/02/skos/core#", "qudt": "http://qudt.org/schema/qudt/",
    "time": "http://www.w3.org/2006/time#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "xsd": "http://www.w3.org/2001/XMLSchema#",
}
ORG_RULES = (
    (r"\bGov\b", "Government"), (r"\bDept\b", "Department"), (r"\bMin\b", "Ministry"), (r"\bUniv\b", "University"),
    (r"\bIntl\b", "International"), (r"\bNatl\b", "National"), (r"\bAssoc\b", "Association"),
    (r"\bOrg\b", "Organization"), (r"\bCorp\b", "Corporation"), (r"\bLtd\b", "Limited"), (r"\bInc\b", "Incorporated"),
    (r"\bCo\b", "Company"), (r"\s*\([^)]*\)\s*$", ""), (r"\s*,\s*$", ""), (r"\s+", " "),
)
ORG_TYPES = {
    "international": (
        "united nations", "world bank", "international", "global", "regional", "asian development", "european",
        "african development",
    ),
    "public": (
        "government", "ministry", "department", "agency", "bureau", "commission", "authority", "council", "administration",
    ),
    "private": (
        "corporation", "company", "ltd", "inc", "llc", "university", "institute", "foundation", "consulting", "group",
    ),
}
ORG_CLASSES = {
    "HealthMinistry": (
        "ministry.*health", "health.*ministry", "department.*health", "health.*department", "health.*welfare", r"moh\b",
        r"mohw\b",
    ),
    "EnvironmentMinistry": (
        "ministry.*environment", "environment.*ministry", "department.*environment", "environment.*department",
        "environmental.*protection", "climate.*ministry",
    ),
    "TransportationMinistry": (
        "transport.*agency", "transport.*ministry", "ministry.*transport", "department.*transport", "roads.*department",
        "aviation.*authority", "maritime.*authority", "transport.*authority",
    ),
    "StatisticalOffice": (
        "bureau.*statistics", "statistics.*bureau", "statistics.*office", "national.*statistics", "statistical.*office",
        "census.*bureau",
    ),
    "EmergencyManagementAgency": (
        "emergency.*management", "disaster.*management", "civil.*defense", "emergency.*services", "disaster.*prevention",
        "crisis.*management",
    ),
    "DevelopmentBank": (
        "development.*bank", "world.*bank", "asian.*development", "african.*development", "inter.*american.*development",
    ),
    "UNAgency": (
        "united.*nations", r"\bun\b", r"undp\b", r"unicef\b", r"who\b", r"unesco\b", r"unep\b", r"unhcr\b",
    ),
    "InsuranceCompany": (
        "insurance", "reinsurance", "re-insurance", "insurer", "mutual.*insurance", "insurance.*company",
    ),
    "University": ("university", "college", "institute.*technology", "school.*medicine", "academic.*institution"),
    "ConsultingFirm": (
        "consulting", "consultancy", "advisory", "solutions", "consulting.*group", "consulting.*firm",
    ),
}
ORG_FALLBACK = {"public": "PublicOrganization", "international": "InternationalOrganization", "private": "PrivateOrganization"}
GENERIC_ORG_WORDS = (
    "university", "institute", "foundation", "association", "company", "corporation", "group", "consulting", "research",
)
CONCEPT_RULES = {
    "Increased Penetration": "Increase Penetration", "Earthquakes & Typhoons": "Natural Catastrophe",
    "Leveraging Tech": "Leveraging Technology", "Increasing Response Efficiency": "Increase Response Efficiency",
    "Raise Awareness": "Raising Awareness", "Accessibilty": "Accessibility",
}
MALFORMED_CONCEPT = ("\n", " Risk ", " Collaboration", " Accessibility")
HAZARD_TERMS = (
    "flood", "flooding", "cyclone", "hurricane", "typhoon", "storm surge", "drought", "wildfire", "bushfire", "landslide",
    "earthquake", "tsunami", "disaster risk", "natural disaster", "natural hazard", "catastrophe",
)
REMEDY_TERMS = (
    "insurance", "financing", "risk transfer", "parametric", "index insurance", "catastrophe bond", "reinsurance",
    "early warning", "contingent credit", "reserve fund", "risk pool", "sovereign risk", "premium subsidy",
)
CLIMATE_TERMS = (
    "climate", "disaster", "earthquake", "flood", "drought", "storm", "weather", "environmental", "risk", "vulnerability",
    "resilience", "adaptation", "financial", "bank", "credit", "loan", "investment", "fund", "capital", "economic",
    "development", "poverty", "reconstruction", "recovery", "nepal", "kathmandu", "government", "policy", "sector",
    "institution",
)
CONCEPT_KEYWORDS = {
    "risks": {
        "sg:FloodRisk": ("flood", "flooding", "inundation", "deluge"),
        "sg:EarthquakeRisk": ("earthquake", "seismic", "tremor"),
        "sg:TyphoonRisk": ("typhoon", "hurricane", "cyclone"),
        "sg:DroughtRisk": ("drought", "water scarcity", "arid"),
        "sg:PandemicRisk": ("pandemic", "epidemic", "outbreak", "covid"),
        "sg:CyberRisk": ("cyber", "ransomware", "data breach", "hacking"),
    },
    "mechanisms": {
        "sg:ParametricInsurance": ("parametric", "index-based", "weather index", "trigger-based"),
        "sg:MicroinsuranceProduct": ("microinsurance", "micro-insurance", "micro insurance"),
        "sg:EarlyWarningSystem": ("early warning", "alert system", "warning system"),
        "sg:RiskPooling": ("risk pool", "pooling", "risk sharing"),
        "sg:PublicPrivatePartnership": ("PPP", "public-private", "government partnership", "public private"),
    },
    "impacts": {
        "sg:EconomicLossReduction": ("economic loss", "financial loss", "reduced losses", "loss reduction"),
        "sg:MortalityReduction": ("mortality", "death", "fatalities", "lives saved"),
        "sg:InsurancePenetrationIncrease": ("penetration", "coverage increase", "insurance uptake"),
        "sg:RecoveryTimeReduction": ("recovery time", "rapid recovery", "faster recovery"),
    },
}
ADMIN_CODES = (
    "A.PCLI", "A.PCLF", "A.PCLD", "A.PCLS", "A.ADM1", "A.ADM1H", "A.ADM2", "A.ADM2H", "A.ADM3", "A.ADM3H", "A.ADM4",
    "A.ADM4H", "A.ADMD", "A.ADMDH", "P.PPLC", "P.PPLA", "P.PPLA2", "P.PPLA3", "P.PPLA4",
)
COUNTRY_NAMES = {
    "US": ("usa", "united states", "america", "us"), "CA": ("canada", "canadian"), "FR": ("france", "french"),
    "DE": ("germany", "german"), "UK": ("united kingdom", "britain", "british", "england"), "IN": ("india", "indian"),
    "CN": ("china", "chinese"), "JP": ("japan", "japanese"), "NP": ("nepal", "nepalese"),
    "BD": ("bangladesh", "bangladeshi"), "PK": ("pakistan", "pakistani"), "LK": ("sri lanka", "sri lankan"),
}
TITLE_REGIONS = {
    "north_american": (("north american", "usa", "united states", "canada"), ("US", "CA")),
    "european": (("european", "europe", "eu"), ("FR", "DE", "IT", "ES", "NL", "BE", "AT", "PT", "GR")),
    "asian": (
        ("asian", "asia", "south asia"),
        ("IN", "CN", "JP", "KR", "TH", "VN", "ID", "MY", "SG", "PH", "BD", "PK", "LK", "NP"),
    ),
}
BOOST_WEIGHTS = {"title": 0.3, "cooccurrence": 0.4, "semantic": 0.2, "type": 0.1}
INDEXED_PREDICATES = {
    "http://www.geonames.org/ontology": (
        "http://www.w3.org/2000/01/rdf-schema#label", "http://www.w3.org/2000/01/rdf-schema#comment",
        "http://www.w3.org/2004/02/skos/core#prefLabel", "http://www.w3.org/2004/02/skos/core#altLabel",
    ),
    "http://www.geonames.org/ontology/data": (
        "http://www.geonames.org/ontology#name", "http://www.geonames.org/ontology#alternateName",
        "http://www.geonames.org/ontology#officialName", "http://www.geonames.org/ontology#shortName",
    ),
    "http://climate-risk-ontology": (
        "http://www.w3.org/2000/01/rdf-schema#label", "http://www.w3.org/2000/01/rdf-schema#comment",
        "http://www.w3.org/2004/02/skos/core#prefLabel", "http://www.w3.org/2004/02/skos/core#altLabel",
        "http://www.w3.org/2004/02/skos/core#definition", "http://www.w3.org/2004/02/skos/core#note",
        "http://climate-risk-ontology#description",
    ),
    "http://www.w3.org/2000/01/rdf-schema": (
        "http://www.w3.org/2000/01/rdf-schema#label", "http://www.w3.org/2000/01/rdf-schema#comment",
    ),
    "http://www.w3.org/2004/02/skos/core": (
        "http://www.w3.org/2004/02/skos/core#prefLabel", "http://www.w3.org/2004/02/skos/core#altLabel",
        "http://www.w3.org/2004/02/skos/core#definition", "http://www.w3.org/2004/02/skos/core#note",
    ),
}
COSTS = {
    "api_unit": 0.0002, "gb_second": 0.0000166667, "managed_seconds": 2.0, "managed_mb": 1024, "local_base_seconds": 3.0,
    "local_seconds_per_1k": 0.5, "local_mb": 3008,
}
BREAK_EVEN_VOLUMES = (10, 50, 100, 500, 1000, 5000, 10000)
