"""Column functions: text, dates and money, web addresses, and the vocabularies they use."""
