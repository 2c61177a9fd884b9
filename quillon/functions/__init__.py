"""Column functions: row-relative series, cleaning, grading."""
