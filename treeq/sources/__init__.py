"""Where forests come from: tables, files, parsed texts."""
