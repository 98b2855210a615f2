"""What turns text into plans: the SQL front end, procedures, schedules, the registered queries."""
