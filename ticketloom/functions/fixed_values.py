"""Word lists, lookup tables, thresholds and message formats.

Everything here is data that other help-desk tools agree on, so the wording
and the order are part of the results.  Code belongs in the sibling modules.
"""

from __future__ import annotations

from importlib import resources

# --- Fixed values: severity keywords, strongest level first -----------------
SEVERITY_RULES = [
    ("Critical", ["complete outage", "system down", "entire company", "data breach",
                  "security breach", "data loss", "ransomware",
                  "cannot access entire system"]),
    ("High", ["urgent", "critical", "multiple users", "business stopped", "cannot work",
              "major issue", "server down", "network down"]),
    ("Medium", ["error", "problem", "issue", "not working", "slow", "failed", "failure"]),
]
DEFAULT_SEVERITY = "Low"

# --- Fixed values: diagnosis keywords, first category wins ------------------
DIAGNOSIS_RULES = [
    ("Hardware", ["laptop", "computer", "keyboard", "mouse", "touchpad", "trackpad",
                  "screen", "monitor", "display", "printer", "printing", "print"]),
    ("VPN / Network", ["vpn", "network", "internet", "connection", "connect", "wifi",
                       "wi-fi", "router", "ethernet"]),
    ("Password / Access", ["password", "login", "sign in", "signin", "locked", "access",
                           "permission"]),
    ("Email", ["email", "mail", "outlook", "gmail", "mailbox"]),
    ("Performance", ["slow", "lag", "freeze", "freezing", "performance", "hang", "hanging"]),
    ("Software", ["software", "application", "app", "program", "crash", "error",
                  "not responding"]),
]
DEFAULT_DIAGNOSIS = "General IT Issue"
DIAGNOSIS_CONFIDENCE = 0.80
DIAGNOSIS_MESSAGE = "Ticket classified as {category} based on detected keywords."
DEFAULT_DIAGNOSIS_MESSAGE = (
    "No specific issue category was detected. Further investigation may be required.")

# --- Fixed values: query spellings unified before retrieval, in this order --
SEARCH_REPLACEMENTS = [("log out", "logout"), ("logging out", "logout"),
                       ("logs out", "logout"), ("logged out", "logout")]
AGENT_REPLACEMENTS = SEARCH_REPLACEMENTS + [("wi fi", "wifi"), ("wi-fi", "wifi")]

# --- Fixed values: retrieval weights and cut-offs ---------------------------
META_WEIGHT, FULL_WEIGHT = 0.90, 0.10
OVERLAP_WEIGHT, PHRASE_WEIGHT = 0.30, 0.50
SEARCH_THRESHOLD, AGENT_THRESHOLD = 0.30, 0.25
SEARCH_TOP_K = 3

# --- Fixed values: decision weights, thresholds, messages -------------------
DIAGNOSIS_SHARE, SIMILARITY_SHARE, STEP_SHARE = 0.40, 0.40, 0.20
FULL_STEP_COUNT = 6
AUTO_RESOLVE_PERCENT = 70
LOW_CONFIDENCE = 0.70
MAX_ATTEMPTS = 3

ARTICLE_FOUND = "Relevant knowledge-base article found."
ARTICLE_MISSING = "No relevant knowledge-base article found."
NO_ARTICLE_RESPONSE = (
    "No relevant knowledge-base article was found for this ticket. "
    "Additional investigation is required.")
ARTICLE_RESPONSE = (
    "A relevant knowledge-base article ('{title}') was found for this issue. "
    "Follow the recommended troubleshooting steps below.")
DEFAULT_STEPS = [
    "Review the relevant knowledge-base article.",
    "Verify the affected device or application.",
    "Check the related configuration and connectivity.",
    "Restart the affected service or application if appropriate.",
    "Retry the operation.",
    "Contact IT support if the issue continues.",
]
AUTO_RESOLVE_MESSAGE = "Confidence is high enough to automatically resolve the ticket."
ESCALATE_MESSAGE = (
    "Confidence is below the automatic-resolution threshold. "
    "The ticket should be escalated.")
HUMAN_NEEDED_MESSAGE = "Ticket requires human support. Escalation initiated."
NO_HUMAN_MESSAGE = "Ticket can be automatically resolved."
ESCALATION_REASONS = [
    ("critical_priority", "Critical priority ticket"),
    ("low_confidence", "AI confidence below 70%"),
    ("validation_failed", "Validation agent requested escalation"),
    ("resolution_failed", "Resolution attempt failed"),
    ("customer_requested_human", "Customer requested human support"),
    ("repeated_attempts", "Repeated resolution attempts reached 3 or more"),
]
OVERRIDE_REASONS = {
    "priority": "Critical priority requires human intervention.",
    "confidence": "AI confidence is below the required threshold.",
    "failed": "AI resolution failed.",
    "human": "Customer requested human support.",
    "attempts": "Repeated attempts reached the escalation threshold.",
}
STATUS_ESCALATED, STATUS_AI_RESOLVED = "Escalated", "AI Resolved"
STATUS_CUSTOMER_RESOLVED, STATUS_OPEN = "Customer Resolved", "Open"
ESCALATION_STATUS = ("Escalated to Human Agent", "Continue AI Resolution")

# --- Fixed values: text spellings of "yes", by field ------------------------
TRUE_WORDS = {
    "human": ["true", "1", "yes", "human"],
    "api_human": ["true", "1", "yes"],
    "correct": ["true", "1", "yes", "correct"],
    "resolved": ["true", "1", "yes", "resolved"],
}
EMPTY_WORDS = ["", "null"]

# --- Fixed values: issue-tracker names of the four priorities ---------------
TRACKER_PRIORITIES = [("P1", "Highest"), ("P2", "High"), ("P3", "Medium"), ("P4", "Low")]

# --- Fixed values: outcome texts of answer generation -----------------------
INSUFFICIENT_RESOLUTION = (
    "Insufficient knowledge-base information was found to generate a reliable "
    "resolution. Additional investigation is required.")
FALLBACK_RESOLUTION = (
    "The AI resolution service is temporarily unavailable. The ticket has been "
    "analyzed and relevant knowledge-base information was retrieved, but an "
    "AI-generated resolution could not be completed. Additional investigation "
    "is required.")
ANALYSIS_MESSAGE = "Ticket analyzed and retrieval query generated."
RETRIEVED_MESSAGE = "{n} relevant knowledge-base article(s) retrieved."
NOT_RETRIEVED_MESSAGE = "No sufficiently relevant knowledge-base articles were found."
CONTEXT_MESSAGE = "Retrieved knowledge from {n} article(s) added to the AI context."
NO_CONTEXT_MESSAGE = "Context could not be created because no relevant articles were retrieved."
GENERATED_MESSAGE = "The model generated the troubleshooting resolution."
NOT_GENERATED_MESSAGE = "Resolution could not be reliably generated from the knowledge base."
FALLBACK_MESSAGE = (
    "Resolution generation was temporarily unavailable after multiple attempts. "
    "Fallback response returned.")

# --- Fixed values: one context block per retrieved article ------------------
CONTEXT_BLOCK = (
    "\nKnowledge Base ID: %d\nTitle: %s\nCategory: %s\nSubcategory: %s\n"
    "Relevance Score: %.4f\n\nContent:\n%s\n")
ANSWER_SECTIONS = ["Likely Cause", "Troubleshooting Steps", "Recommended Resolution",
                   "Knowledge Base Source"]
#: What each section should hold; the wording is our own.
ANSWER_GUIDANCE = [
    "The cause that the extracts make most probable.",
    "What to try, one numbered step per line.",
    "What to tell the customer to do.",
    "Id and title of the article that this rests on."]
#: Calls of the scorer per ticket, and what a call without a text counts as.
MAX_SCORER_ATTEMPTS = 3
NO_RESPONSE_ERROR = "The model returned no response."
EMPTY_RESPONSE_ERROR = "The model returned an empty response."
BLANK_RESPONSE_ERROR = "The model returned nothing but white space."

# --- Fixed values: knowledge-article texts, first matching rule wins --------
ARTICLE_TITLE = "{subcategory} Troubleshooting Guide"
ARTICLE_OPENING = "This guide covers {subcategory}. "
ARTICLE_RULES = [
    (["touchpad"],
     "The issue may occur if the touchpad is disabled, if the touchpad settings are "
     "incorrect, if its device driver is not functioning correctly, or if there is a "
     "hardware problem. Troubleshooting should begin by checking whether the touchpad has "
     "been disabled using the laptop settings or function keys. Check the operating-system "
     "touchpad settings and confirm that the device is enabled. Next, check the touchpad "
     "device and driver status. Restart the laptop and test the touchpad again. If the "
     "touchpad is still not responding, inspect the hardware for possible physical or "
     "connectivity problems. If these checks do not resolve the issue, additional hardware "
     "or driver investigation is required."),
    (["keyboard"],
     "First check whether the keyboard is connected and recognized by the computer. Restart "
     "the computer and test the keyboard again. Check the keyboard settings and verify that "
     "the keyboard device and driver are functioning correctly. For an external keyboard, "
     "check the cable, USB connection, or wireless connection. If specific keys remain "
     "unresponsive, inspect the keyboard for physical damage. If the problem continues, "
     "additional hardware or driver investigation is required."),
    (["screen", "display", "monitor", "brightness", "dim"],
     "First check the display brightness and operating-system display settings. Verify that "
     "the display is receiving power and that the display connection is secure when "
     "applicable. Restart the computer and test the display again. Check the graphics or "
     "display driver status if the problem continues. Look for visible physical damage to "
     "the display. If the display remains abnormal after these checks, additional hardware "
     "or display-driver investigation is required."),
    (["mouse"],
     "Check whether the mouse is properly connected or paired. For a wireless mouse, check "
     "the power and wireless connection. For a wired mouse, check the cable and USB "
     "connection. Restart the computer and test the mouse again. Check the mouse device and "
     "driver status. If the mouse still does not work, test another compatible mouse to help "
     "determine whether the problem is hardware related."),
    (["battery"],
     "Check the battery level and confirm that the charger is properly connected. Verify "
     "that the operating system detects the battery and charger correctly. Restart the "
     "computer and check the battery status again. Inspect the charging cable and power "
     "connection for visible problems. If charging or battery problems continue, additional "
     "battery or hardware investigation is required."),
    (["printer"],
     "Check that the printer is powered on and connected to the computer or network. Verify "
     "that the correct printer is selected and that there are no pending or failed print "
     "jobs. Check the printer driver and connection status. Restart the printer and test "
     "printing again. If the problem continues, check for printer hardware or network "
     "connectivity problems."),
    (["install"],
     "First record any error message displayed during installation. Verify that the "
     "application version is compatible with the operating system and that the required "
     "installation files are available. Check available storage and required user "
     "permissions. Restart the computer and attempt the installation again. If installation "
     "continues to fail, review the error information and investigate application "
     "dependencies."),
    (["crash"],
     "Reproduce the problem and record any error message generated when the application "
     "crashes. Restart the application and test again. Check whether the application is "
     "updated and whether the system meets its requirements. Review application settings "
     "and relevant error logs. If the application continues to crash, additional software "
     "or dependency investigation is required."),
    (["not responding"],
     "First check whether the application is still processing an operation or has become "
     "unresponsive. Wait briefly and test again. If it remains unresponsive, restart the "
     "application. Check available system resources and application settings. Verify that "
     "the application and its required components are properly installed and updated. If "
     "the issue continues, review relevant application logs and investigate further."),
    (["browser"],
     "Restart the browser and reproduce the problem. Check whether the browser is updated to "
     "a supported version. Review browser extensions and settings that may affect operation. "
     "Clear temporary browser data when appropriate and test again. Check whether the "
     "problem occurs with another website or browser. If the issue persists, review browser "
     "logs or perform additional software investigation."),
    (["password", "account", "login", "authentication", "authorization", "permission",
      "access", "credential"],
     "First identify the affected user account and the resource the user is trying to "
     "access. Verify that the credentials are entered correctly. Check whether the account "
     "is active and whether it has the required permissions. Check for account restrictions "
     "or authentication problems. Retry the login or access operation after correcting any "
     "identified issue. If access remains unavailable, additional account or permission "
     "investigation is required."),
    (["vpn"],
     "Check the network connection before starting the VPN. Verify the VPN configuration and "
     "confirm that the correct credentials are being used. Restart the VPN connection and "
     "test again. Check whether the required network service is reachable. If the VPN still "
     "fails, investigate configuration, authentication, or network connectivity problems."),
    (["dns"],
     "Check whether the device has a valid network connection. Verify the configured DNS "
     "settings and test whether the required hostname can be resolved. Restart the network "
     "connection and test again. If the issue continues, investigate DNS configuration and "
     "network connectivity."),
    (["network", "connection", "connectivity", "internet", "wifi", "wi-fi"],
     "First verify that the affected device is connected to the correct network. Check the "
     "network adapter and confirm that the device has a valid network configuration. Test "
     "connectivity to the required service or destination. Restart the network connection "
     "and test again. If the problem continues, compare the affected device with a working "
     "device and investigate network configuration or infrastructure problems."),
    (["suspicious", "security", "malware", "phishing", "spoof", "attack", "unauthorized",
      "compromise", "breach", "threat"],
     "Identify the affected account, device, or network activity. Review available security "
     "and authentication logs for unusual activity. Check for unexpected processes, "
     "connections, or access attempts. Preserve relevant information for further "
     "investigation. Do not assume the cause without sufficient evidence. If suspicious "
     "activity remains present or indicates a possible security incident, additional "
     "security investigation is required."),
]
ARTICLE_FALLBACK = (
    "Begin by reproducing the reported problem and identifying the affected system or "
    "component. Check relevant configuration, connectivity, permissions, software "
    "components, and system status where applicable. Review available error messages or "
    "logs. Restart the affected component and test again. If the problem continues, "
    "additional investigation is required.")


def english_stop_words() -> list[str]:
    """The stop list shipped as a text resource; pass another list to replace it."""
    text = resources.files("ticketloom.resources").joinpath(
        "english_stop_words.txt").read_text(encoding="utf-8")
    return [word for line in text.splitlines() if not line.startswith("#")
            for word in line.split()]
