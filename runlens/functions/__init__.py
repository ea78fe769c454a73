"""Column functions: parsing, templating, classification, and the user-expression compiler."""
