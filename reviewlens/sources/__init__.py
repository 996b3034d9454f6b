from reviewlens.sources.tables import (  # noqa: F401
    REVIEWS_SCHEMA, BOOKS_SCHEMA, scan_reviews, scan_books, scan_table,
    source_catalog, normalize_review_columns, normalize_book_columns,
)
from reviewlens.sources.synthetic import synthetic_reviews  # noqa: F401
