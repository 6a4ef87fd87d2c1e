"""These must equal the published study's lists for equal results."""

# Topic -> search keywords (23 topics, 67 keywords).
TOPIC_KEYWORDS = {
    "relational theory": [
        "relational theory", "relational theory relations",
        "relational theory tuples", "relational theory attributes",
    ],
    "tuple relational calculus": ["tuple relational calculus"],
    "relational algebra": ["relational algebra"],
    "data visualization": ["data visualization"],
    "database optimization": [
        "database optimization", "database optimization indexing",
        "database optimization query execution plans", "database optimization query optimization",
    ],
    "database scalability": [
        "database scalability", "database scalability replication", "database scalability sharding",
    ],
    "NoSQL database management systems": ["NoSQL database management systems"],
    "logical and physical data independence": [
        "data independence", "logical data independence",
        "physical data independence", "logical and physical data independence",
    ],
    "database management system components": ["database management system components"],
    "functions and stored procedures": ["functions and stored procedures"],
    "data modeling": [
        "data modeling", "data modeling conceptual modeling",
        "data modeling mapping conceptual models to logical models",
        "data modeling creating tables and columns",
    ],
    "database normalization": [
        "database normalization", "database normalization functional dependency",
        "database normalization candidate", "database normalization super keys",
        "database normalization normal forms up to BCNF",
        "database normalization multivalued dependency", "database normalization join dependency",
    ],
    "object-oriented data models": ["object-oriented data models"],
    "semi-structured traditional data models": ["semi-structured traditional data models"],
    "SQL": [
        "SQL", "SQL select", "SQL project", "SQL join", "SQL insert", "SQL update", "SQL delete",
        "SQL aggregation", "SQL group by", "SQL subqueries", "SQL common table expressions",
    ],
    "transaction processing": ["transaction processing"],
    "concurrency control and isolation levels": [
        "concurrency control", "isolation levels", "concurrency control and isolation levels",
    ],
    "database back-ups and recovery": [
        "database back-ups", "database recovery", "database back-ups and recovery",
    ],
    "distributed database management systems": ["distributed database management systems"],
    "data mining": [
        "data mining", "data mining algorithms", "data mining associative pattern",
        "data mining sequential pattern", "data mining associative and sequential patterns",
        "data mining data cleaning", "data mining market basket analysis",
    ],
    "data privacy and ethics": ["data privacy", "data ethics", "data privacy and ethics"],
    "data security and database access management": [
        "data security", "database access management",
        "data security and database access management",
    ],
    "data warehousing": ["data warehousing"],
}

KEYWORDS = [keyword for keywords in TOPIC_KEYWORDS.values() for keyword in keywords]

# Display labels of language and country codes.
LANGUAGE_LABELS = {
    "en": "English",
    "en-US": "English (US)",
    "en-GB": "English (UK)",
    "en-IN": "English (India)",
    "hi": "Hindi",
    "N/A": "Not Available",
}
COUNTRY_LABELS = {"US": "United States", "IN": "India", "GB": "United Kingdom"}

# Day on which ages are measured.
SNAPSHOT_DATE = "2024-12-24"

# Smallest group that enters a group comparison or keeps its own dummy column.
MIN_GROUP_SIZE = 30

# Cost of a missed positive and of a false alarm when the threshold is tuned.
COST_FALSE_NEGATIVE = 1.0
COST_FALSE_POSITIVE = 2.0
THRESHOLD_GRID = 100

# Word limits of the labelling prompt and size of the labelling sample.
DESCRIPTION_WORDS = 150
TRANSCRIPT_WORDS = 500
TRAINING_SAMPLE_ROWS = 3000
