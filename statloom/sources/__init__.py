"""Reading workbooks and files; writing results."""
