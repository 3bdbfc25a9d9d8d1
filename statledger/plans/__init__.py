"""Jobs made of the operators: cleaning, loading, marts and ad-hoc queries."""
